"""Fixed values.

Everything in this module is data that has to be exactly this for results to
come out right: word lists, code maps, patterns, formats and limits.
"""

# ---- fixed values: genders -------------------------------------------------
MALE_SPELLINGS = ["male", "men", "mens", "m", "man"]
FEMALE_SPELLINGS = ["female", "women", "womens", "f", "woman", "ladies"]

# ---- fixed values: title categories, first match wins ----------------------
CATEGORY_KEYWORDS = [
    ("kurta", ["kurta", "kurti"]),
    ("shalwar", ["shalwar", "kameez", "salwar"]),
    ("dupatta", ["dupatta"]),
    ("saree", ["saree", "sari"]),
    ("lawn-suit", ["lawn", "unstitched"]),
    ("t-shirt", ["t-shirt", " tee", "tee ", "tshirt"]),
    ("shirt", ["shirt", "blouse", "button-down", "oxford"]),
    ("hoodie", ["hoodie", "hooded"]),
    ("sweatshirt", ["sweatshirt", "crewneck"]),
    ("sweater", ["sweater", "jumper", "knit", "cardigan", "pullover"]),
    ("jacket", ["jacket", "blazer", "coat", "parka", "vest", "anorak"]),
    ("jeans", ["jeans", "denim"]),
    ("pants", ["pants", "trouser", "chino", "joggers", "leggings"]),
    ("shorts", ["shorts"]),
    ("skirt", ["skirt"]),
    ("dress", ["dress", "gown", "maxi"]),
    ("shoes", ["shoe", "sneaker", "boot", "trainer", "loafer", "sandal"]),
    ("hat", ["hat", "cap", "beanie"]),
    ("bag", ["bag", "backpack", "tote"]),
    ("scarf", ["scarf", "shawl", "stole"]),
    ("accessory", ["belt", "sock", "glove", "tie"]),
    ("underwear", ["underwear", "boxer", "brief", "bra"]),
]
DEFAULT_CATEGORY = "other"

# ---- fixed values: gender signals ------------------------------------------
FEMALE_URL_HINTS = [
    "/women", "/womens", "/woman", "/ladies", "/female", "/girls", "/girl-",
    "-womens-", "-women-", "/her/", "/for-her",
]
MALE_URL_HINTS = [
    "/men", "/mens", "/male", "/boys", "/boy-", "-mens-", "-men-", "/him/",
    "/for-him", "/guys",
]
MALE_URL_VETOES = ["women", "ladies", "female", "girl"]
FEMALE_TITLE_PATTERN = (
    r"\b(women|woman|womens|ladies|female|girls?|dresses?|skirts?|blouses?|gowns?"
    r"|sarees?|saris?|kurtas?|kurtis?|dupattas?|lingerie|bikinis?|bras?|panties?"
    r"|camisoles?|leggings?)\b"
)
MALE_TITLE_PATTERN = (
    r"\b(mens?|man|male|boys?|guys?|gentleman|boxers?|neckties?|tuxedos?)\b"
)
FEMALE_CATEGORIES = ["dress", "skirt", "saree", "kurta", "dupatta", "lawn-suit"]

# ---- fixed values: sizes ----------------------------------------------------
SIZE_NAMES = [
    "XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL", "2XL", "3XL", "4XL", "5XL",
    "SMALL", "MEDIUM", "LARGE", "ONE SIZE", "OS", "ONESIZE", "FREE SIZE",
]
DEFAULT_SIZES = ["One Size"]
DEFAULT_COLORS = ["Default"]
UNLISTED_OPTIONS = ["See site"]
DEFAULT_TITLE = "Untitled"
DEFAULT_DESCRIPTION = "No description available"

# ---- fixed values: countries and currencies ---------------------------------
COUNTRIES = [
    ("US", "United States", "USD"),
    ("CA", "Canada", "CAD"),
    ("GB", "United Kingdom", "GBP"),
    ("IE", "Ireland", "EUR"),
    ("AU", "Australia", "AUD"),
    ("DE", "Germany", "EUR"),
    ("NL", "Netherlands", "EUR"),
    ("FR", "France", "EUR"),
    ("IT", "Italy", "EUR"),
    ("PK", "Pakistan", "PKR"),
]
COUNTRY_CODES = [code for code, _, _ in COUNTRIES]
UNKNOWN_COUNTRY = "Unknown"
FALLBACK_COUNTRY = "US"
FALLBACK_CURRENCY = "USD"
COUNTRY_TLDS = {"GB": "uk", "US": "com"}  # every other code is its own TLD
CURRENCY_SYMBOLS = {
    "USD": "$", "GBP": "£", "EUR": "€", "CAD": "C$", "AUD": "A$", "PKR": "Rs.",
}

# ---- fixed values: discovery -------------------------------------------------
GENERIC_SITES = [
    "amazon", "ebay", "etsy", "walmart", "target", "aliexpress", "shein", "temu",
    "wikipedia", "pinterest", "instagram", "facebook", "twitter", "youtube",
    "reddit", "linkedin", "snapchat", "tiktok", "google", "bing", "yahoo", "quora",
    "trustpilot", "yelp",
]
DISCOVERY_QUERIES = [
    "hoodie", "t-shirt", "jacket", "dress", "kurta", "jeans", "sweater", "shoes",
    "pants", "shirt", "coat", "shorts", "sweatshirt", "skirt", "blouse",
]
DISCOVERY_PHRASE = "%s clothing brand online shop %s"
SHOP_WORDS = ["shop", "store", "buy"]
FEATURES = ["url_length", "is_com", "is_country_tld", "has_shop", "subdomain_depth"]
MIN_PRIMARY_RESULTS = 3
MIN_TRAINING_ROWS = 6
MIN_SUCCESS_PROBABILITY = 0.20
FOREST_TREES = 50
FOREST_SEED = 42

# ---- fixed values: page patterns ----------------------------------------------
JSONLD_PATTERN = (
    r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
)
WRAPPED_LINK_PATTERN = r'uddg=(https?%3A[^&"]+)'
DIRECT_LINK_PATTERN = r'<a[^>]+href="(https?://[^"&]{10,})"'

# ---- fixed values: cleaning, ranking and paging -------------------------------
DUPLICATE_KEYS = [
    "brand", "title", "price", "currency", "url", "image_url", "category",
    "country", "gender",
]
OUTLIER_FACTOR = 10.0
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6
INDEXED_COLUMNS = ["title", "brand", "colors", "category", "gender"]
SEARCH_LIMIT = 60
RECOMMENDATIONS = 12
PAGE_SIZE = 48
