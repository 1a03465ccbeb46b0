"""Lists, patterns and constants that results depend on, each in its natural order."""

# Company registry (display name first among the names).
COMPANIES = {
    "TSLA": {
        "names": ["Tesla", "TSLA", "Tesla Inc", "Tesla, Inc.", "$TSLA"],
        "person": ["Musk", "Elon Musk", "Elon"],
        "products": ["Model S", "Model 3", "Model X", "Model Y", "Cybertruck", "Cybercab", "Semi", "Roadster", "Powerwall", "Megapack", "Megafactory", "Optimus", "FSD", "Full Self-Driving", "Autopilot", "Robotaxi", "Supercharger", "Dojo"],
    },
    "NVDA": {
        "names": ["Nvidia", "NVDA", "Nvidia Corp", "Nvidia Corporation", "$NVDA"],
        "person": ["Jensen Huang", "Huang", "Jensen"],
        "products": ["Blackwell", "Hopper", "Ada Lovelace", "Ampere", "GeForce", "RTX", "GTX", "CUDA", "Omniverse", "DGX", "Grace", "NVLink", "Tensor Core", "DLSS", "Jetson", "Quadro", "Shield TV", "Drive"],
    },
    "KO": {"names": ["Coca-Cola", "Coca Cola", "Coke", "KO", "$KO"]},
    "BYD": {"names": ["BYD"]},
    "F": {"names": ["Ford", "Ford Motor"]},
    "GM": {"names": ["General Motors", "GM"]},
    "RIVN": {"names": ["Rivian"], "products": ["R1T", "R1S"]},
    "LCID": {"names": ["Lucid Motors", "Lucid"], "products": ["Air", "Gravity"]},
    "TM": {"names": ["Toyota"]},
    "VOW": {"names": ["Volkswagen", "VW"]},
    "NIO": {"names": ["NIO"]},
    "AAPL": {
        "names": ["Apple", "AAPL", "Apple Inc", "Apple Inc.", "$AAPL"],
        "person": ["Tim Cook", "Steve Jobs"],
        "products": ["iPhone", "iPad", "Mac", "MacBook", "MacBook Air", "MacBook Pro", "iMac", "Apple Watch", "AirPods", "Vision Pro", "iOS", "macOS", "iPadOS", "App Store", "Siri", "Apple Intelligence", "Apple TV", "HomePod"],
    },
    "AMZN": {
        "names": ["Amazon", "AMZN", "Amazon.com", "Amazon Inc", "Amazon Inc.", "$AMZN"],
        "person": ["Andy Jassy", "Jassy", "Jeff Bezos", "Bezos"],
        "products": ["AWS", "Amazon Web Services", "Prime", "Amazon Prime", "Prime Video", "Alexa", "Kindle", "Echo", "Fire TV", "Whole Foods", "Amazon Music", "Ring", "Amazon Go", "Kuiper", "Bedrock"],
    },
    "SpaceX": {"names": ["SpaceX"]},
    "X Corp": {"names": ["X Corp", "X.com"]},
    "UBER": {"names": ["Uber"]},
    "Waymo": {"names": ["Waymo"]},
    "MU": {"names": ["Micron"]},
    "TXN": {"names": ["Texas Instruments"]},
    "BBW": {"names": ["Build-A-Bear"]},
}

# Price-commentary patterns, strong and weak tier.
MOVE_VERBS = (
    r"(rises?|falls?|slides?|slips?|surges?|jumps?|climbs?|tumbles?|sinks?|dips?|sank|sunk|"
    r"gains?|drops?|plunges?|soars?|rallies?|retreats?|declines?|advances?|"
    r"rebounds?|bounces?|rockets?|spikes?|"
    r"rose|fell|slid|slipped|surged|jumped|climbed|tumbled|sank|"
    r"gained|dropped|plunged|soared|rallied|retreated|declined|advanced|"
    r"rebounded|bounced|rocketed|spiked)"
)
STRONG_PATTERNS = [
    rf"(?<!market\s)\bshares?\s+(?:\w+\s+){{0,2}}{MOVE_VERBS}",
    rf"\bstocks?\s+(?:\w+\s+){{0,2}}{MOVE_VERBS}",
    r"\bstocks?\s+(closed|opened|traded|finished)\b",
    r"\b(up|down|off)\s+\d+(\.\d+)?\s*%",
    r"\b\d+(\.\d+)?\s*%\s+(higher|lower|gain|loss|drop|jump|surge|rally|slide|tumble|plunge|rebound)\b",
    r"\bextend(s|ed|ing)?\s+(gains|losses|slide|rally)\b",
    r"\bhit(s|ting)?\s+(a\s+)?(new\s+)?(record|all-time)\s+(high|low)\b",
    r"\b(52|fifty-two)[- ]week\s+(high|low)\b",
]
WEAK_PATTERNS = [
    r"\b(rally|selloff|sell-off|slump|surge|plunge|rout|rebound)\b",
    r"\bhere'?s\s+why\b",
    r"\binvestors?\s+(weighed|reacted|shrugged|cheered|punished)\b",
    r"\b(outperform|underperform)(ed|ing)?\b",
    r"\b(premarket|pre-market|after[- ]hours)\s+(trading|movers?)\b",
    r"\bmoving\s+(the\s+)?(market|stock)s?\b",
    r"\b(top|biggest)\s+(gainers?|losers?|movers?)\b",
    r"\bwhat'?s\s+(driving|behind)\b",
    r"\b(shares?|stocks?)\s+(?:is|are|was|were)\s+(up|down)\b",
]
#: Words without which a pattern cannot fire, in lower case: one of each group must be in the text.
STRONG_WORDS = [
    [["share"]], [["stock"]], [["stock"], ["closed", "opened", "traded", "finished"]], [["%"], ["up", "down", "off"]],
    [["%"], ["higher", "lower", "gain", "loss", "drop", "jump", "surge", "rally", "slide", "tumble", "plunge", "rebound"]],
    [["extend"], ["gains", "losses", "slide", "rally"]], [["hit"], ["record", "all-time"], ["high", "low"]], [["52-week", "52 week", "fifty-two-week", "fifty-two week"]],
]
WEAK_WORDS = [
    [["rally", "selloff", "sell-off", "slump", "surge", "plunge", "rout", "rebound"]], [["why"], ["here"]], [["investor"]], [["outperform", "underperform"]],
    [["premarket", "pre-market", "after-hours", "after hours"]], [["moving"], ["market", "stock"]], [["gainer", "loser", "mover"], ["top", "biggest"]], [["driving", "behind"], ["what"]], [["share", "stock"], ["up", "down"]],
]

# Which mentions a company name may stand for.
MENTION_PRONOUNS = ["it", "its", "they", "their", "them", "theirs", "it's", "it’s", "they're", "they’re"]
MENTION_DETERMINERS = ["the", "this", "its", "their", "our"]
COMPANY_HEAD_NOUNS = ["company", "firm", "business", "corporation", "corp", "group", "conglomerate", "powerhouse", "giant", "maker", "automaker", "carmaker", "chipmaker", "manufacturer", "automotive", "brand", "stock", "security", "outfit", "enterprise"]
MOST_MENTION_TOKENS = 6
TITLE_WORDS = r"(?<![A-Za-z0-9])(?:CEO|CFO|CTO|COO|chief executive|co-founder|cofounder|founder|chairman|chairwoman|chairperson|president|boss|billionaire|billionaires|tycoon|magnate|mogul|entrepreneur)(?![A-Za-z0-9])"

# Inflection of a name put in place of a pronoun.
POSSESSIVE_PRONOUNS = ["its", "their", "his", "her", "our", "your"]
CONTRACTIONS_IS = ["it's", "it’s", "he's", "he’s", "she's", "she’s"]
CONTRACTIONS_ARE = ["they're", "they’re", "we're", "we’re"]
BARE_PRONOUNS = ["it", "they", "he", "she"]
CLITICS = [("'ll", "will"), ("’ll", "will"), ("'ve", "has"), ("’ve", "has"), ("'re", "is"), ("’re", "is"), ("'s", "is"), ("’s", "is"), ("'d", "would"), ("’d", "would")]

# Tuning constants.
CONF_FLOOR = 0.7
SHRINKAGE_K = 4.0
LEAD_SENTENCES = 5
LEAST_SENTENCE_CHARS = 20
BOILERPLATE_ARTICLES = 5
LEAST_BODY_CHARS = 500
MOST_SHIFT_HOURS = 6
MOST_CROSS_HOST_SHIFT_DAYS = 30
MOMENTUM_LOOKBACKS = [1, 5, 20]
WINDOW = 20
NEWS_VOLUME_DAYS = 3
CONTEXT_PRECEDING, CONTEXT_FOLLOWING = 4, 1
OPEN_SOURCES = ["Yahoo", "Benzinga", "DowJones"]
SESSIONS = ["pre-market", "market-hours", "after-hours"]
CHANNELS = ["surface", "coref_span", "coref_nospan"]
TRUSTED_CHANNELS = ["surface", "coref_span"]
FETCH_CAP = 100
SCRAPE_WORKERS = 8
SCRAPE_CHUNK = 500
BODY_CHROME_TAGS = ["script", "style", "nav", "aside", "footer", "header", "form", "figure"]
