"""Codes and defaults that come from the input files and the published tables."""

# Codes as they are spelled in the input files.
FEDERAL_DEPUTY = "deputado federal"
CORPORATE_ORIGIN = "recursos de pessoas juridicas"
ACCEPTED_REGISTRATION = ("deferido", "deferido com recurso")
NO_MUNICIPALITY = 0
NON_AUTOMATIC = "Não automática"
AUTOMATIC = "Automática"
PARTY = "PT"

# Result codes that mean "won a seat"; the key None holds for every year not listed.
WINNER_STATUSES = {
    2014: ("eleito por qp", "eleito por media"),
    None: ("eleito", "eleito por media"),
}
# Result codes whose margin is measured from the best loser, in every year.
MARGIN_STATUSES = ("eleito", "eleito por media")

# Labels of the elected factor.
ELECTED_LABELS = {0: "Não eleito", 1: "Eleito"}

# Birth places that the candidate file spells wrong.
PLACE_ALIASES = {"MAZAG AO": "MAZAGAO"}

# Study design.
ELECTIONS = (2006, 2010, 2014)
YEARS_AFTER = 4
BASE_SIZE = 5
BANDWIDTH = 25000
FIRST_YEAR = 2002
LAST_REVENUE_YEAR = 2019
VOLUME_YEARS = (2002, 2018)

# Significance marks and the two-sided normal critical values of 0.1, 0.05, 0.01, 0.001.
STARS = (("***", 3.290527), ("**", 2.575829), ("*", 1.959964), ("+", 1.644854))
