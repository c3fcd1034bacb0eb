"""Word lists, lookup entries, patterns and constants that results depend on.

They are data, in their natural order; order matters where a list says so.
"""

# Country keywords, matched as substrings of lower-cased text, first in the list wins.
COUNTRY_KEYWORDS = [
    ("usa", "US"),
    ("america", "US"),
    ("united states", "US"),
    ("russia", "RU"),
    ("russian", "RU"),
    ("putin", "RU"),
    ("china", "CN"),
    ("chinese", "CN"),
    ("xi jinping", "CN"),
    ("germany", "DE"),
    ("german", "DE"),
    ("merkel", "DE"),
    ("france", "FR"),
    ("french", "FR"),
    ("macron", "FR"),
    ("ukraine", "UA"),
    ("ukrainian", "UA"),
    ("zelensky", "UA"),
    ("uk", "GB"),
    ("britain", "GB"),
    ("british", "GB"),
]

# Leader keywords, first in the list wins.
LEADER_KEYWORDS = [
    ("biden", "Joe Biden"),
    ("trump", "Donald Trump"),
    ("putin", "Vladimir Putin"),
    ("xi jinping", "Xi Jinping"),
    ("macron", "Emmanuel Macron"),
    ("zelensky", "Volodymyr Zelensky"),
    ("scholz", "Olaf Scholz"),
    ("sunak", "Rishi Sunak"),
]

# Country gazetteer (name, code, alternatives).
COUNTRY_GAZETTEER = [
    ("United States", "USA", ["US", "USA", "America", "United States of America"]),
    ("United Kingdom", "GBR", ["UK", "Britain", "Great Britain"]),
    ("Russia", "RUS", ["Russian Federation"]),
    ("China", "CHN", ["PRC", "People's Republic of China"]),
    ("France", "FRA", ["French Republic"]),
    ("Germany", "DEU", ["Federal Republic of Germany", "Deutschland"]),
    ("Japan", "JPN", ["Nippon"]),
    ("Ukraine", "UKR", []),
    ("European Union", "EU", ["EU"]),
    ("North Korea", "PRK", ["DPRK", "Democratic People's Republic of Korea"]),
]

# Leader gazetteer (name, alternatives).
LEADER_GAZETTEER = [
    ("Donald Trump", ["Trump", "Former President Trump"]),
    ("Joe Biden", ["Biden", "President Biden"]),
    ("Vladimir Putin", ["Putin", "President Putin"]),
    ("Xi Jinping", ["Xi", "President Xi"]),
    ("Emmanuel Macron", ["Macron", "President Macron"]),
    ("Rishi Sunak", ["Sunak", "PM Sunak"]),
    ("Olaf Scholz", ["Scholz", "Chancellor Scholz"]),
    ("Volodymyr Zelenskyy", ["Zelenskyy", "Zelensky", "President Zelenskyy"]),
    ("Ursula von der Leyen", ["von der Leyen", "VDL"]),
    ("Kamala Harris", ["Harris", "Vice President Harris", "VP Harris"]),
]

# Country aliases for reports, keyed by the upper-cased, trimmed name.
COUNTRY_ALIASES = {
    "US": "USA",
    "USA": "USA",
    "UNITED STATES": "USA",
    "UNITED STATES OF AMERICA": "USA",
    "UK": "United Kingdom",
    "GB": "United Kingdom",
    "GREAT BRITAIN": "United Kingdom",
    "UNITED KINGDOM": "United Kingdom",
    "RUSSIA": "Russia",
    "RF": "Russia",
    "RUS": "Russia",
    "RUSSIAN FEDERATION": "Russia",
    "CHINA": "China",
    "PRC": "China",
    "PEOPLE'S REPUBLIC OF CHINA": "China",
    "UAE": "United Arab Emirates",
    "UNITED ARAB EMIRATES": "United Arab Emirates",
    "EU": "European Union",
    "EUROPEAN UNION": "European Union",
}

# Leader aliases for reports, case-sensitive.
LEADER_ALIASES = {
    "Macron": "Emmanuel Macron",
    "Sunak": "Rishi Sunak",
    "Trump": "Donald Trump",
    "Biden": "Joe Biden",
    "Putin": "Vladimir Putin",
    "Xi": "Xi Jinping",
}

# Map codes that differ from the plain ISO lookup.
ISO_SPECIAL = {
    "USA": "USA",
    "United Kingdom": "GBR",
    "Russia": "RUS",
    "European Union": "EUR",
    "United Arab Emirates": "ARE",
}

# ISO 3166-1 rows (name, alpha-2, alpha-3) of often named countries, for the SQL that
# checks `country_iso`; the operator itself takes all countries from the JVM's locale data.
ISO_COUNTRIES = [
    ("Afghanistan", "AF", "AFG"),
    ("Argentina", "AR", "ARG"),
    ("Armenia", "AM", "ARM"),
    ("Australia", "AU", "AUS"),
    ("Austria", "AT", "AUT"),
    ("Azerbaijan", "AZ", "AZE"),
    ("Bangladesh", "BD", "BGD"),
    ("Belarus", "BY", "BLR"),
    ("Belgium", "BE", "BEL"),
    ("Brazil", "BR", "BRA"),
    ("Bulgaria", "BG", "BGR"),
    ("Canada", "CA", "CAN"),
    ("Chile", "CL", "CHL"),
    ("China", "CN", "CHN"),
    ("Colombia", "CO", "COL"),
    ("Croatia", "HR", "HRV"),
    ("Cuba", "CU", "CUB"),
    ("Czechia", "CZ", "CZE"),
    ("Denmark", "DK", "DNK"),
    ("Egypt", "EG", "EGY"),
    ("Estonia", "EE", "EST"),
    ("Ethiopia", "ET", "ETH"),
    ("Finland", "FI", "FIN"),
    ("France", "FR", "FRA"),
    ("Georgia", "GE", "GEO"),
    ("Germany", "DE", "DEU"),
    ("Greece", "GR", "GRC"),
    ("Hungary", "HU", "HUN"),
    ("Iceland", "IS", "ISL"),
    ("India", "IN", "IND"),
    ("Indonesia", "ID", "IDN"),
    ("Iran", "IR", "IRN"),
    ("Iraq", "IQ", "IRQ"),
    ("Ireland", "IE", "IRL"),
    ("Israel", "IL", "ISR"),
    ("Italy", "IT", "ITA"),
    ("Japan", "JP", "JPN"),
    ("Kazakhstan", "KZ", "KAZ"),
    ("Kenya", "KE", "KEN"),
    ("Latvia", "LV", "LVA"),
    ("Lebanon", "LB", "LBN"),
    ("Lithuania", "LT", "LTU"),
    ("Malaysia", "MY", "MYS"),
    ("Mexico", "MX", "MEX"),
    ("Moldova", "MD", "MDA"),
    ("Morocco", "MA", "MAR"),
    ("Netherlands", "NL", "NLD"),
    ("New Zealand", "NZ", "NZL"),
    ("Nigeria", "NG", "NGA"),
    ("North Korea", "KP", "PRK"),
    ("Norway", "NO", "NOR"),
    ("Pakistan", "PK", "PAK"),
    ("Palestine", "PS", "PSE"),
    ("Peru", "PE", "PER"),
    ("Philippines", "PH", "PHL"),
    ("Poland", "PL", "POL"),
    ("Portugal", "PT", "PRT"),
    ("Qatar", "QA", "QAT"),
    ("Romania", "RO", "ROU"),
    ("Russian Federation", "RU", "RUS"),
    ("Saudi Arabia", "SA", "SAU"),
    ("Serbia", "RS", "SRB"),
    ("Singapore", "SG", "SGP"),
    ("Slovakia", "SK", "SVK"),
    ("Slovenia", "SI", "SVN"),
    ("South Africa", "ZA", "ZAF"),
    ("South Korea", "KR", "KOR"),
    ("Spain", "ES", "ESP"),
    ("Sudan", "SD", "SDN"),
    ("Sweden", "SE", "SWE"),
    ("Switzerland", "CH", "CHE"),
    ("Syria", "SY", "SYR"),
    ("Taiwan", "TW", "TWN"),
    ("Thailand", "TH", "THA"),
    ("Turkey", "TR", "TUR"),
    ("Ukraine", "UA", "UKR"),
    ("United Arab Emirates", "AE", "ARE"),
    ("United Kingdom", "GB", "GBR"),
    ("United States", "US", "USA"),
    ("Venezuela", "VE", "VEN"),
    ("Vietnam", "VN", "VNM"),
    ("Yemen", "YE", "YEM"),
]

# Automated authors (lower case) and name patterns, as applied at ingest.
KNOWN_BOTS = [
    "automoderator",
    "botdefense",
    "repostsleuthbot",
    "transcribot",
    "translator-bot",
    "reddit-stream",
    "remindmebot",
    "converter-bot",
]
BOT_PATTERNS = ["bot$", "^bot", "_bot_", "^auto", "moderator"]

# The longer lists for the strict filter.
KNOWN_BOTS_STRICT = KNOWN_BOTS + [
    "tweetposter",
    "wikitextbot",
    "commonmisspellingbot",
    "linkfixerbot",
    "totesmessenger",
    "goodbot_badbot",
    "magic_eye_bot",
    "helperbot_",
]
BOT_PATTERNS_STRICT = BOT_PATTERNS + ["transcriber", "translator"]

# Constants of the published sentiment rules (Hutto & Gilbert, ICWSM 2014).
NORMALIZATION_ALPHA = 15
BOOST = 0.293
BOOST_DECAY = (1.0, 0.95, 0.9)
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
EXCLAMATION_BOOST = 0.292
MAX_EXCLAMATIONS = 4
BEFORE_PIVOT = 0.5
AFTER_PIVOT = 1.5
PIVOT_WORD = "but"

# Words that strengthen (+) or soften (-) the next opinion word.
BOOSTERS = {
    "absolutely": BOOST,
    "amazingly": BOOST,
    "completely": BOOST,
    "deeply": BOOST,
    "enormously": BOOST,
    "entirely": BOOST,
    "especially": BOOST,
    "extremely": BOOST,
    "fully": BOOST,
    "greatly": BOOST,
    "highly": BOOST,
    "hugely": BOOST,
    "incredibly": BOOST,
    "more": BOOST,
    "most": BOOST,
    "particularly": BOOST,
    "really": BOOST,
    "so": BOOST,
    "strongly": BOOST,
    "totally": BOOST,
    "truly": BOOST,
    "unusually": BOOST,
    "utterly": BOOST,
    "very": BOOST,
    "almost": -BOOST,
    "barely": -BOOST,
    "hardly": -BOOST,
    "kinda": -BOOST,
    "less": -BOOST,
    "little": -BOOST,
    "marginally": -BOOST,
    "occasionally": -BOOST,
    "partly": -BOOST,
    "scarcely": -BOOST,
    "slightly": -BOOST,
    "somewhat": -BOOST,
    "sorta": -BOOST,
}

# Negators.
NEGATORS = [
    "aint",
    "ain't",
    "aren't",
    "can't",
    "cannot",
    "couldn't",
    "didn't",
    "doesn't",
    "don't",
    "hadn't",
    "hasn't",
    "haven't",
    "isn't",
    "neither",
    "never",
    "no",
    "nobody",
    "none",
    "nope",
    "nor",
    "not",
    "nothing",
    "nowhere",
    "rarely",
    "seldom",
    "shouldn't",
    "wasn't",
    "weren't",
    "without",
    "won't",
    "wouldn't",
]

# The small default lexicon (-4 to 4). Many ratings are those of the published lexicon
# of Hutto & Gilbert (2014). Pass a full one with `read_lexicon`.
LEXICON = {
    "abuse": -3.0,
    "admire": 2.1,
    "afraid": -1.9,
    "aggressive": -1.4,
    "agree": 1.5,
    "amazing": 2.8,
    "angry": -2.3,
    "annoying": -1.7,
    "attack": -2.1,
    "awesome": 3.1,
    "awful": -2.0,
    "bad": -2.5,
    "beautiful": 2.9,
    "benefit": 2.0,
    "best": 3.2,
    "better": 1.9,
    "betray": -2.7,
    "boring": -1.3,
    "brave": 2.4,
    "brilliant": 2.8,
    "brutal": -3.0,
    "calm": 1.3,
    "care": 2.0,
    "catastrophe": -3.2,
    "celebrate": 2.7,
    "cheat": -2.0,
    "clown": -1.2,
    "collapse": -2.1,
    "corrupt": -3.0,
    "coward": -2.0,
    "crazy": -1.4,
    "crime": -2.5,
    "crisis": -3.0,
    "cruel": -2.8,
    "damage": -2.2,
    "danger": -2.4,
    "dead": -3.2,
    "death": -2.9,
    "defeat": -2.0,
    "destroy": -2.5,
    "disaster": -3.1,
    "disgusting": -2.4,
    "dishonest": -2.7,
    "dumb": -2.3,
    "easy": 1.9,
    "enemy": -2.2,
    "enjoy": 2.2,
    "evil": -3.4,
    "excellent": 2.7,
    "excited": 1.4,
    "fail": -2.5,
    "failure": -2.3,
    "fair": 1.3,
    "fake": -2.1,
    "fantastic": 2.6,
    "fear": -2.2,
    "filthy": -2.0,
    "fraud": -2.8,
    "free": 2.3,
    "freedom": 3.2,
    "friend": 2.2,
    "fun": 2.3,
    "garbage": -1.8,
    "glad": 2.0,
    "good": 1.9,
    "great": 3.1,
    "guilty": -1.8,
    "happy": 2.7,
    "hate": -2.7,
    "helpful": 1.8,
    "hero": 2.6,
    "honest": 2.3,
    "hope": 1.9,
    "horrible": -2.5,
    "hostile": -1.6,
    "idiot": -2.3,
    "ignorant": -1.1,
    "illegal": -2.6,
    "important": 0.8,
    "improve": 1.9,
    "insane": -1.7,
    "insult": -2.3,
    "interesting": 1.7,
    "joke": 1.2,
    "joy": 2.8,
    "kill": -3.7,
    "kind": 2.4,
    "liar": -2.3,
    "lie": -1.6,
    "like": 1.5,
    "lose": -1.7,
    "loser": -2.4,
    "loss": -1.3,
    "love": 3.2,
    "lucky": 1.8,
    "moron": -2.2,
    "murder": -3.7,
    "nasty": -2.6,
    "nice": 1.8,
    "outrage": -2.3,
    "pain": -2.3,
    "panic": -2.3,
    "pathetic": -2.7,
    "peace": 2.5,
    "perfect": 2.7,
    "pleased": 1.9,
    "poison": -2.5,
    "poor": -2.1,
    "positive": 2.6,
    "problem": -1.7,
    "progress": 1.8,
    "prosper": 2.4,
    "proud": 2.1,
    "racist": -3.0,
    "respect": 2.1,
    "ridiculous": -1.5,
    "risk": -1.1,
    "sad": -2.1,
    "safe": 1.9,
    "scam": -2.7,
    "scum": -2.6,
    "shame": -2.1,
    "sick": -2.3,
    "smart": 1.7,
    "strong": 2.3,
    "stupid": -2.4,
    "success": 2.7,
    "suffer": -2.5,
    "support": 1.7,
    "terrible": -2.1,
    "terror": -2.4,
    "thank": 1.5,
    "thanks": 1.9,
    "threat": -2.4,
    "tragedy": -3.4,
    "trash": -1.9,
    "treason": -2.8,
    "trust": 2.3,
    "ugly": -2.3,
    "unfair": -2.1,
    "useless": -1.8,
    "victim": -1.1,
    "victory": 2.6,
    "vile": -2.9,
    "violence": -3.1,
    "war": -2.9,
    "weak": -1.9,
    "welcome": 2.0,
    "win": 2.8,
    "wonderful": 2.7,
    "worse": -2.1,
    "worst": -3.1,
    "worthless": -1.9,
    "wrong": -2.1,
}
