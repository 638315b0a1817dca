"""Vocabularies, aliases, limits and texts the results depend on."""

# Keywords that hint at a product category, in matching order.
CATEGORY_PATTERNS = {
    "cleanser": ["cleanser", "wash", "gel"],
    "serum": ["serum", "ampoule"],
    "moisturizer": ["moisturizer", "cream", "lotion"],
    "sunscreen": ["sunscreen", "spf", "sun block", "sunblock"],
    "toner": ["toner", "essence"],
    "exfoliant": ["exfoliant", "aha", "bha", "salicylic", "glycolic"],
}

# Keywords per skin type, in matching order.
SKIN_TYPES = {
    "dry": ["dry"],
    "oily": ["oily"],
    "combination": ["combination", "combo"],
    "sensitive": ["sensitive"],
    "normal": ["normal"],
    "acne-prone": ["acne-prone"],
}

# Terms that call for the dermatologist note.
MEDICAL_TERMS = [
    "psoriasis",
    "eczema",
    "dermatitis",
    "rosacea",
    "severe acne",
    "allergy",
    "allergies",
    "pregnancy",
    "pregnant",
    "lactation",
    "isotretinoin",
    "accutane",
]

# Price wording by language.
PRICE_PATTERNS = {
    "english": {
        "under": ["under", "below", "<"],
        "between": ["to", "-"],
        "currency": ["$", "usd", "€", "eur"],
    },
    "spanish": {
        "under": ["menos de", "<"],
        "between": ["a", "-"],
        "currency": ["€", "eur"],
    },
}

# Canonical catalog field -> source headers, by preference.
SCHEMA_MAP = {
    "product_name": ["Product", "product", "Name"],
    "price_eur": ["Price (€)", "Price"],
    "category": ["Category"],
    "skin_types": ["Skin types", "Skin_types"],
    "recommended_for": ["Recommended for"],
    "benefits": ["Main functions"],
    "features": ["Features"],
    "key_ingredients": ["Key ingredients"],
    "brand": ["Brand"],
    "size": ["Size"],
    "contraindications": ["Contraindications"],
    "short_description": ["Description"],
}

# Catalog text fields that are normalised at load time.
TEXT_FIELDS = [
    "product_name",
    "category",
    "skin_types",
    "benefits",
    "features",
    "key_ingredients",
    "recommended_for",
    "brand",
    "size",
    "contraindications",
    "short_description",
    "tags",
]

# Fields of the retrieval text, in order (the price text comes last).
RETRIEVAL_FIELDS = [
    "product_name",
    "brand",
    "category",
    "short_description",
    "benefits",
    "features",
    "key_ingredients",
    "skin_types",
    "recommended_for",
    "tags",
]

# Columns that make up the embedding corpus when none are named, in a fixed order.
CORPUS_FIELDS = ["product", "name", "title", "description", "benefits", "brand", "category", "tags"]

# Header aliases of the catalog validator.
COLUMN_ALIASES = {
    "product": ["product", "name", "title", "producto", "nombre"],
    "price": ["price", "price (€)", "precio", "precio (€)", "pvp"],
    "category": ["category", "categoría", "category_name"],
    "description": ["description", "descripción", "details"],
}
REQUIRED_COLUMNS = ["product", "price", "category"]
MAX_NULL_RATIO = 0.05
MIN_DESCRIPTION_CHARS = 10
DUPLICATE_EXAMPLES = 10

# Cells the CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Longest text kept on a lean card, per field.
LEAN_LIMITS = {"key_ingredients": 200, "short_description": 280, "benefits": 280}

DEFAULT_DAILY_LIMIT = 1000
DEFAULT_TOP_K = 5
INDEX_VERSION = "retriever_v1"
EMBEDDING_MODEL = "text-embedding-3-large"
EMBEDDING_DIM = 384
EMBEDDING_BATCH = 100

# USD per million tokens.
TOKEN_PRICES = {"embedding": 0.02, "chat_prompt": 0.15, "chat_completion": 0.60}

# Upper bounds in seconds of the latency histogram (the metrics client's defaults).
LATENCY_BUCKETS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"),
]

# Files each tenant needs.
REQUIRED_PROMPTS = [
    "compose_prompt.txt",
    "few_shot_prompt.txt",
    "greeting_prompt.txt",
    "no_match_prompt.txt",
    "system_prompt.txt",
]
REQUIRED_PATTERNS = ["category_patterns.yaml", "price_patterns.yaml", "schema_map.yaml"]
CATALOG_FILE = "products_catalog.csv"

# Fixed texts of the answers.
SAFETY_LINE = (
    "- Since a medical condition was mentioned, add a gentle note to consult a dermatologist "
    "before using products.\n"
)
APOLOGY = (
    "Sorry, I couldn’t generate a reply just now. "
    "Could you share a bit more about your skin type and any budget? "
    "I’ll try again right away."
)
GREETING_FALLBACK = (
    "Hi! Good {TIME_OF_DAY}. I’m your skincare specialist at {STORE_NAME}. "
    "Tell me about your skin (e.g., dry, oily, sensitive) and if you have a budget, "
    "and I’ll suggest the best options."
)

# Lines of the catalog quality report.
REPORT_ERRORS = {
    "missing": "Columna '{COLUMN}' tiene {PERCENT}% valores nulos (> 5%)",
    "bad_price": "{N} filas con precio inválido",
    "negative_price": "{N} filas con precio negativo",
    "duplicates": "{N} productos duplicados (ejemplos: {NAMES})",
}
REPORT_WARNINGS = {
    "zero_price": "{N} filas con precio 0.00",
    "unknown_categories": "categorías desconocidas: {NAMES}",
    "not_judged": "No se validaron categorías (falta data/patterns/category_patterns.yaml o 'categories')",
    "short_descriptions": "{N} descripciones con menos de {LIMIT} caracteres",
}

# Details of refused requests.
AUTH_NO_CLIENT = "client_id is required"
AUTH_UNKNOWN = "Unknown client_id: "
AUTH_BAD_KEY = "Invalid API key"

# Transliterations that are not one plain letter for one accented letter.
TRANSLITERATIONS = {
    "ß": "ss", "ẞ": "Ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)", "™": "(tm)", "…": "...", "—": "--", "«": "<<",
    "»": ">>", "°": "deg", "½": "1/2", "¼": "1/4", "¾": "3/4",
}
SINGLE_LETTERS = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i",
    "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "‐": "-", "‑": "-", "×": "x", "÷": "/",
    "¿": "?", "¡": "!", "·": "*", "•": "*", "µ": "u", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
