"""Word lists and patterns of the normalisers."""

# Results depend on every entry and on the order of the maps.
LEGAL_WORDS = (
    "corp|corporation|incorporated|inc|ltd|limited|pvt|private|llc|llp|gmbh|ag|sa|sarl|sas|sasu|plc|bv|nv|spa|srl|sl|cie|co|company|eurl|sci|snc|gie|earl|gaec|scp|selarl|ei|eirl|"
    r"praivet|praivrr|piraivet|praibhet|praiveta|limirrd|limitet|limittad|prvt|pvtltd|pvt-ltd|elelpi|pra\s*li|prali"
)
STOPWORDS = (
    "and the & of in at on for by corp limited pvt ltd inc llc des les aux sur sous sci eurl sarl sasu sas association asso club groupe group "
    "centre center societe society ecole school de du la le et d l un une en pour dans par"
).split()
ADDRESS_MAP = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "ln": "lane", "bldg": "building", "apt": "apartment", "ste": "suite",
    "fl": "floor", "dr": "drive", "ct": "court", "pkwy": "parkway", "opp": "opposite", "near": "near", "r": "street", "rue": "street",
    "av": "avenue", "bd": "boulevard", "imp": "impasse", "pl": "place",
}
LEGAL_FORMS = [
    r"pvt\s*ltd", r"private\s*limited", "limited", "ltd", "llc", "inc", "incorporated", "corporation", "corp", "co", "company", "sarl", "gmbh", "llp",
    "sa", "sas", "sasu", "eurl", "sci", "snc", "gie", "earl", "gaec", "praivet", "praivrr", "piraivet", "praibhet", "praiveta", "limirrd", "limitet",
    "limittad", "prvt", "pvtltd", "elelpi", r"pra\s*li", "prali",
]
HONORIFICS = r"m\s*/\s*s|ms|dr|sri|shri|shree|om|smt|the"
BRAND_ENDINGS = "corp|corporation|incorporated|inc|ltd|limited|pvt|private|llc|llp|elelpi|com|in|net|org"
BRAND_PREFIX = "llc|inc|corp|ltd|pvt"
UNIT_WORDS = "plot|shop|flat|sector|gut|sec|gala|survey|sy|phase|road|rd|hno|door|dno"
NUMBER_WORDS = r"no\.|no\b|plot|door|bldg|flat|h\.?no\.?"
NUMBER_TAIL = "bis|ter|[a-d]"
STREET_WORDS = "r|rue|av|ave|bd|blvd|all|imp|che|rte"
ADDRESS_STOPWORDS = (
    "street avenue boulevard road floor building nagar colony bazaar market complex tower towers enclave layout sector district state india pradesh "
    "maharashtra karnataka tamil nadu gujarat delhi bengal mumbai bangalore kolkata chennai hyderabad village taluk post near opp opposite behind beside "
    "front france paris lyon marseille bordeaux lille toulouse cedex nouvelle aquitaine hauts alpes provence grand occitanie"
).split()
DEFAULT_THRESHOLDS = {"US": 0.980, "India": 0.970, "France": 0.970, "default": 0.970}
POSTING_CAPS = {"P": 80, "AT": 150, "default": 300}
FEATURES = "ntj nts nlv nc3 twc tcc lex acr nsm mnm pcm mpc ljc slv ac3 alv mad nld phs cbs ukm".split()
SIMPLE_STOPWORDS = ("and", "the", "for", "ltd", "pvt", "inc", "corp", "llc")
DOTTED = r"(?U)\b([a-z])\.(?:\s*([a-z])\.?)+"
SIMPLE_NUMBER = r"(?U)\b\d{1,6}(?:[a-zA-Z]|bis|ter)?\b"
SIMPLE_CODE = r"(?U)\b\d{5,6}\b"
HOUSE = r"(\d+\s*(?:bis|ter|[a-zA-Z])?)"
HOUSE_PREFIX = r"\b(?:no\.?|plot|door|bldg)\s*[:#-]?\s*"
HOUSE_STREET = r"\b(?:rue|road|street|st|ave|avenue|bd|boulevard|lane)\s+[^,]*?\b"
# End of fixed values.
