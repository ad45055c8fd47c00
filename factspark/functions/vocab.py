"""Fixed vocabularies.  Every value here is data the results depend on."""

# fixed values: entity types
ENTITY_TYPES = [
    "company", "investor", "entity", "university", "facility", "asset", "person",
    "document_node", "event", "program", "funding_program", "end_user", "geography",
]
# fixed values: entity status
ENTITY_STATUS = ["active", "merged", "disputed", "dormant"]
# fixed values: entity types that may be compared with each other
TYPE_GROUPS = {
    "company": "org", "entity": "org", "investor": "org", "university": "org",
    "end_user": "org", "facility": "org",
    "person": "person", "asset": "asset",
    "program": "program", "funding_program": "program",
}
# fixed values: research frame per entity type
RESEARCH_FRAME = {
    "company": "company", "investor": "company", "entity": "company",
    "university": "company", "asset": "asset", "funding_program": "funding_program",
    "end_user": "end_user", "program": "question", "facility": "question",
    "person": "person", "event": "question",
}
# fixed values: event types
EVENT_TYPES = [
    "funding_round", "grant_award", "grant_call", "ipo", "spac", "debt_financing",
    "convertible", "crowdfunding", "launch", "contract_award", "partnership",
    "acquisition", "failure", "pivot", "regulatory", "milestone", "leadership",
    "publication", "research_grant",
]
# fixed values: frames used by the gap and staleness reports (assets use the company frame)
REPORT_FRAME = {**RESEARCH_FRAME, "asset": "company"}
CALL_STATUS = ["open", "upcoming", "closed"]
SIGNIFICANCE = ["high", "medium", "low"]
# fixed values: event types listed on the funding report
FUNDING_TYPES = [
    "funding_round", "grant_award", "grant_call", "ipo", "spac", "debt_financing",
    "convertible", "crowdfunding", "research_grant",
]
# fixed values: event types that sum into a raised total, and who may raise
EQUITY_TYPES = ["funding_round", "ipo", "spac", "debt_financing", "convertible", "crowdfunding"]
RAISING_TYPES = ["company", "university", "end_user"]
# fixed values: fragment categories
FRAGMENT_CATEGORIES = [
    "technical", "financial", "competitive", "regulatory", "strategic", "operational",
    "people", "challenge", "research",
]
# fixed values: supply predicates, levels, and the older flat tiers
SUPPLY_PREDICATES = [
    "supplies", "contracted_by", "customer_of", "manufactures", "launches_for",
    "launched_payload",
]
LEVELS = ["upstream", "midstream", "downstream", "institutional", "other"]
FLAT_TIER_LEVEL = {
    "raw_material": "upstream", "component": "upstream", "subsystem": "upstream",
    "system": "midstream", "integrator": "midstream", "operator": "downstream",
    "data_service": "downstream", "end_user": "downstream",
}
# fixed values: second path parts of the retired tier vocabulary
RETIRED_TIER_PARTS = [
    "propulsion", "structures", "avionics", "software", "launch", "comms",
    "earth_observation", "ground_segment", "navigation", "power", "thermal",
    "manufacturing", "instruments", "robotics", "life_support", "re_entry",
    "services", "data", "finance", "testing", "integration", ".other.",
]
# fixed values: facets that apply to each entity type
FACETS_FOR_TYPE = {
    "company": ["value_chain", "orbit_regime", "customer_type", "maturity", "research_area", "adjacent_sector"],
    "investor": ["value_chain", "customer_type", "maturity", "adjacent_sector"],
    "entity": ["value_chain", "orbit_regime", "customer_type", "maturity", "research_area", "adjacent_sector"],
    "university": ["research_area", "adjacent_sector"],
    "funding_program": ["funding_type"],
    "program": ["value_chain", "orbit_regime"],
    "person": ["research_area"],
    "asset": ["value_chain", "orbit_regime"],
    "end_user": ["adjacent_sector", "customer_type", "value_chain"],
}
SCORED_TYPES = ["company", "investor", "entity", "university", "person"]
CORRECTABLE_TYPES = [
    "company", "entity", "investor", "university", "facility", "asset", "person",
    "program", "funding_program", "end_user", "geography",
]
# fixed values: trailing words a normalised name drops
NAME_SUFFIXES = [
    "inc", "llc", "ltd", "corp", "co", "gmbh", "sa", "sas", "bv", "ag", "plc", "sl",
    "slu", "spa", "nv", "oy", "ab",
    "foundation", "institute", "institution", "association", "society", "consortium",
    "authority", "agency", "centre", "center", "hub", "network", "alliance",
    "initiative", "cluster", "programme", "program",
    "technologies", "technology", "systems", "solutions", "group", "holdings",
    "services", "industries", "international", "enterprises", "aerospace", "space",
    "aviation", "robotics", "dynamics", "labs", "laboratory",
]
# fixed values: legal endings that make a world-knowledge lookup pointless
LEGAL_SUFFIXES = [
    "inc", "llc", "ltd", "corp", "gmbh", "sa", "sas", "bv", "ag", "plc", "sl", "slu",
    "spa", "nv", "oy", "ab", "as", "aps",
]
# fixed values: place names that are never companies
PLACE_NAMES = [
    "europe", "north america", "south america", "asia", "africa", "oceania", "antarctica",
    "united", "united kingdom", "united states", "united arab", "united arab emirates",
    "uae", "france", "germany", "spain", "italy", "japan", "china", "india", "canada",
    "australia", "brazil", "russia", "south korea", "israel", "norway", "sweden",
    "netherlands", "belgium", "switzerland", "austria", "portugal", "poland", "ukraine",
    "turkey", "saudi arabia", "new zealand", "singapore", "luxembourg",
    "catalonia", "cataluna", "scotland", "wales", "flanders", "brittany", "bavaria",
    "ile de france", "lombardy", "andalusia",
    "london", "paris", "berlin", "madrid", "rome", "tokyo", "beijing", "washington",
    "brussels", "geneva", "amsterdam", "stockholm", "oslo", "helsinki", "toulouse",
    "munich", "barcelona", "milan", "cape canaveral", "houston", "new york",
    "los angeles", "san francisco", "seattle", "boston", "denver", "austin", "chicago",
    "dallas", "miami", "toronto", "montreal", "vancouver", "dubai", "abu dhabi",
    "tel aviv", "sydney", "melbourne", "bangalore", "mumbai", "new delhi", "shanghai",
    "seoul", "osaka", "vienna", "zurich", "warsaw", "prague", "lisbon", "copenhagen",
    "kyiv", "istanbul", "athens", "bucharest", "budapest", "sofia",
]
# fixed values: country names -> ISO 3166-1 alpha-2
COUNTRY_CODES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.": "US",
    "u.s.a.": "US", "america": "US", "united states (usa)": "US",
    "united kingdom": "GB", "u.k.": "GB", "great britain": "GB", "britain": "GB",
    "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "united arab emirates": "AE", "uae": "AE", "u.a.e.": "AE",
    "south korea": "KR", "korea": "KR", "republic of korea": "KR", "korea, south": "KR",
    "north korea": "KP", "czech republic": "CZ", "czechia": "CZ", "russia": "RU",
    "russian federation": "RU", "the netherlands": "NL", "netherlands": "NL",
    "holland": "NL", "hong kong sar": "HK", "hong kong": "HK",
    "republic of ireland": "IE", "ireland": "IE", "republic of poland": "PL",
    "federal republic of germany": "DE", "germany": "DE", "spain": "ES", "france": "FR",
    "italy": "IT", "portugal": "PT", "belgium": "BE", "switzerland": "CH",
    "austria": "AT", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI",
    "poland": "PL", "luxembourg": "LU", "greece": "GR", "turkey": "TR", "israel": "IL",
    "india": "IN", "japan": "JP", "china": "CN", "taiwan": "TW", "australia": "AU",
    "new zealand": "NZ", "canada": "CA", "mexico": "MX", "brazil": "BR",
    "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE",
    "south africa": "ZA", "singapore": "SG", "indonesia": "ID", "malaysia": "MY",
    "thailand": "TH", "vietnam": "VN", "philippines": "PH", "nigeria": "NG",
    "kenya": "KE", "egypt": "EG", "saudi arabia": "SA", "qatar": "QA", "ukraine": "UA",
    "romania": "RO", "hungary": "HU", "bulgaria": "BG", "croatia": "HR",
    "slovakia": "SK", "slovenia": "SI", "estonia": "EE", "latvia": "LV",
    "lithuania": "LT", "iceland": "IS", "deutschland": "DE", "españa": "ES",
    "espana": "ES", "italia": "IT", "nederland": "NL", "sverige": "SE", "suomi": "FI",
    "danmark": "DK", "norge": "NO", "polska": "PL", "österreich": "AT",
    "osterreich": "AT", "belgique": "BE", "belgië": "BE", "belgie": "BE",
    "schweiz": "CH", "suisse": "CH", "svizzera": "CH", "卢森堡": "LU",
}
# fixed values: publication domain -> trust
DOMAIN_TRUST = {
    "nasa.gov": 92, "esa.int": 92, "jaxa.jp": 88, "roscosmos.ru": 80,
    "isro.gov.in": 85, "cnes.fr": 85, "dlr.de": 85, "ukspace.agency": 82,
    "spacex.com": 85, "rocketlabusa.com": 83, "blueorigin.com": 83,
    "virgingalactic.com": 80, "planet.com": 80, "maxar.com": 80, "airbus.com": 82,
    "boeing.com": 82, "lockheedmartin.com": 82, "northropgrumman.com": 82,
    "arianespace.com": 83, "ula.com": 82,
    "spacenews.com": 80, "spaceflightnow.com": 78, "nasaspaceflight.com": 76,
    "aviationweek.com": 78, "thespacereview.com": 72, "parabolicarc.com": 68,
    "spacedaily.com": 65, "universetoday.com": 65,
    "reuters.com": 82, "bloomberg.com": 80, "ft.com": 82, "wsj.com": 80,
    "bbc.com": 78, "theguardian.com": 74, "nytimes.com": 76, "techcrunch.com": 65,
    "wired.com": 65, "arstechnica.com": 70,
    "wikipedia.org": 55,
    "twitter.com": 32, "x.com": 32, "reddit.com": 28, "facebook.com": 28,
}
# fixed values: trust by domain ending, and for unknown domains
DOMAIN_ENDING_TRUST = [(".gov", 88), (".int", 85), (".edu", 75), (".mil", 85)]
DEFAULT_TRUST = 55
# fixed values: words that mark a name as in or out of the field
FIELD_WORDS = [
    "space", "spacecraft", "satellite", "rocket", "launch", "orbit", "orbital",
    "propulsion", "propellant", "thruster", "payload", "fairing", "booster",
    "reusable", "smallsat", "cubesat", "nanosat", "microsat", "constellation",
    "spaceport", "launchpad", "launch site", "launch vehicle", "upper stage",
    "earth observation", "remote sensing", "sar", "optical imaging", "ground station",
    "telemetry", "mission control", "flight software", "astronaut", "cosmonaut",
    "crewed", "human spaceflight", "nasa", "esa", "roscosmos", "jaxa", "isro", "csa",
    "cnsa", "uksa", "spacex", "rocketlab", "rocket lab", "arianespace", "ula ",
    "virgin", "in-orbit", "in orbit", "debris", "space debris", "sts", "iss ",
    "geostationary", "geo ", "leo ", "meo ", "sso ", "vleo", "interplanetary",
    "lunar", "mars", "moon ", "asteroid", "space tourism", "space station",
    "in-space", "space infrastructure", "new space", "newspace", "space industry",
    "space economy",
]
OFF_FIELD_WORDS = [
    "telecom carrier", "mobile network", "internet service provider", "retail bank",
    "investment bank", "insurance company", "supermarket", "retail chain", "fast food",
    "pharmaceutical", "automotive oem", "car manufacturer", "oil and gas",
    "oil company", "mining company", "steel manufacturer",
]
ALWAYS_RELEVANT_TYPES = ["asset", "facility", "event", "program", "funding_program", "end_user"]
# fixed values: description words that make a registry match plausible
REGISTRY_HINTS = [
    "space", "aerospace", "satellite", "rocket", "launch ", "orbital", "defence",
    "defense", "aerospace company", "space agency", "aviation", "telescope",
    "spacecraft", "astronautics", "aeronautics",
]
# fixed values: default price per thousand tokens (in, out)
DEFAULT_RATE = (0.001, 0.003)
# fixed values: days between checks per cadence
CADENCE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "event_driven": 0}
