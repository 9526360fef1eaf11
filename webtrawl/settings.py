"""Limits and fixed value lists of the crawl engine.

Every number here is a default only: each operator takes its limit as an argument, and None for
no limit where the limit cuts texts or tables.
"""

MAX_DEPTH = 10
DOMAIN_MAX = 200
DOMAIN_LIMIT = 2
CONCURRENCY = 2
MAX_REDIRECTS = 5
MAX_BODY_BYTES = 512 * 1024
META_TEXT_LIMIT = 1000
QUERY_LIMIT = 500
SNIPPET_LIMIT = 250
DOC_ID_LIMIT = 512
HITS_PER_QUERY = 30
SEED_BATCH = 500
RECRAWL_SAMPLE = 15
RECRAWL_DEPTH = -1
TOP_DOMAINS = 20
URL_PARTITIONS = 6
SNAPSHOT_KEEP_DAYS = 7

BLOCK_MIN_TOTAL = 20
BLOCK_RATIO = 0.9

RATE_WINDOW_MS = 60_000
RATE_MAX = 100
RATE_SEARCH_MAX = 30

BREAKER_THRESHOLD = 5
BREAKER_RESET_MS = 30_000
BREAKER_HALF_OPEN_MAX = 3

RETRY_MAX = 3
RETRY_BASE_MS = 1000
RETRY_FACTOR = 2
RETRY_CAP_MS = 30_000

SLOW_REQUEST_MS = 1000
MINUTES_PER_MONTH = 43_800
AVAILABILITY_TARGET = 99.9

# Domains that are never crawled (their subdomains included).
BLOCKLIST = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "snapchat.com",
    "linkedin.com", "pinterest.com", "reddit.com", "threads.net", "mastodon.social",
    "doubleclick.net", "googlesyndication.com", "google-analytics.com", "googletagmanager.com",
    "ads.yahoo.com", "advertising.com", "facebook.net", "fbcdn.net", "amazon-adsystem.com",
    "adservice.google.com", "pagead2.googlesyndication.com", "adnxs.com", "adsrvr.org",
    "demdex.net", "casalemedia.com", "cloudflareinsights.com", "bat.bing.com", "mc.yandex.ru",
    "amazonaws.com", "cloudfront.net", "akamaihd.net", "quantserve.com", "scorecardresearch.com",
    "bluekai.com", "rubiconproject.com", "pubmatic.com", "openx.net", "criteo.com", "criteo.net",
    "taboola.com", "outbrain.com",
)

# Encyclopedia languages used for seed URLs.
SEED_LANGS = (
    "en", "ru", "de", "fr", "es", "ja", "zh", "pt", "it", "pl", "nl", "sv", "ar", "tr", "uk", "vi",
    "th", "id", "ko", "cs", "fi", "no", "da", "he", "ro", "hu", "bn", "fa",
)

# Encyclopedia topics used for seed URLs.
SEED_TOPICS = (
    "History", "Science", "Mathematics", "Physics", "Chemistry", "Biology", "Medicine", "Astronomy",
    "Geology", "Ecology", "Evolution", "Genetics", "Neuroscience", "Philosophy", "Psychology",
    "Sociology", "Anthropology", "Economics", "Politics", "Geography", "Architecture", "Music",
    "Literature", "Art", "Film", "Theater", "Television", "Video_games", "Sports", "Chess",
    "Football", "Basketball", "Agriculture", "Engineering", "Robotics", "Automation",
    "Telecommunications", "Electricity", "Nuclear_energy", "Solar_energy", "Wind_power",
    "Climate_change", "Democracy", "Capitalism", "Socialism", "Revolution", "War", "Peace",
    "Ancient_Rome", "Ancient_Greece", "Ancient_Egypt", "Medieval", "Renaissance",
    "Industrial_Revolution", "Cold_War", "World_War_II", "World_War_I", "Einstein", "Newton",
    "Tesla", "Edison", "Darwin", "Curie", "Hawking", "Shakespeare", "Mozart", "Beethoven",
    "Da_Vinci", "Michelangelo", "Quantum_mechanics", "Relativity", "String_theory", "Dark_matter",
    "Black_hole", "DNA", "Protein", "Virus", "Bacteria", "Coffee", "Tea", "Beer", "Wine", "Bread",
    "Pizza", "Sushi", "Dinosaur", "Mammal", "Bird", "Fish", "Insect", "Spider", "Ocean", "Mountain",
    "River", "Desert", "Forest", "Island", "Sun", "Moon", "Mars", "Jupiter", "Saturn", "Milky_Way",
    "Apollo_program", "International_Space_Station", "Hubble_Space_Telescope",
)

# Load-test query strings.
SAMPLE_QUERIES = [
    "python", "javascript", "machine learning", "history",
    "physics", "web", "database", "algorithm",
]

# Latency limits in ms per request kind, as (kind, p95, p99).
LATENCY_LIMITS = [("search", 500, 1000), ("stats", 200, 500), ("page", 300, 600)]

# Service-level objectives as (name, comparison, target).
SLO_TARGETS = [
    ("availability_pct", ">=", 99.9),
    ("error_rate_pct", "<", 15.0),
    ("pages_per_second", ">", 10.0),
    ("freshness_hours", "<", 24.0),
]

# Alert rules as (name, comparison, limit, seconds it must hold).
ALERT_RULES = [
    ("ServiceDown", "==", 0.0, 60),
    ("HighErrorRate", ">", 0.3, 300),
    ("DiskAlmostFull", "<", 0.1, 60),
    ("MemoryHigh", ">", 350.0 * 1024 * 1024, 300),
    ("LowThroughput", "<", 5.0, 600),
]
