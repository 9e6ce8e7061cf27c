"""Fixed values of the normalisers: they have to be just these for results to agree."""

# Legal forms and generic business words, as single words of a cleaned name.
LEGAL_SUFFIXES = tuple(
    """inc incorporated corp corporation llc llp ltd limited pvt private co company services enterprises
    solutions holdings group consulting center trust industries associates sons brothers bros
    sarl sasu sas sa eurl sci snc fils cie societe france""".split()
)

# Address abbreviations and their long forms.
ADDRESS_WORDS = {
    "st": "street", "saint": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "aven": "avenue",
    "dr": "drive", "blvd": "boulevard", "bd": "boulevard", "bvd": "boulevard", "ln": "lane", "ct": "court", "cir": "circle",
    "pl": "place", "fl": "floor", "ste": "suite", "apt": "apartment", "dept": "department", "no": "number", "nr": "near",
    "opp": "opposite", "pkwy": "parkway", "hwy": "highway", "fwy": "freeway", "r": "rue", "imp": "impasse", "all": "allee",
    "chem": "chemin", "rte": "route", "crs": "cours", "qu": "quai",
}

# Address words that do not tell places apart.
GENERIC_ADDRESS = tuple(
    """street road avenue drive lane court circle place floor suite apartment department number near opposite
    parkway highway freeway north south east west null and the for with city state delhi mumbai india usa france
    rue boulevard impasse allee chemin route""".split()
)

# Name words that make no blocking key.
NAME_STOP_WORDS = tuple(
    """and the for with near opp road street avenue city floor shop plot door main cross colony nagar market
    complex plaza bhavan building delhi mumbai chennai bangalore""".split()
)

DOMAIN_WORDS = tuple("com fr in org net co edu gov".split())
