"""Rule tables of the text functions. All are defaults: callers can pass their own."""

from __future__ import annotations

# Punctuation that folding deletes.
PUNCTUATION = "’'‘`ʾʿ\"“”.,:;()[]{}!?…—–-/"
# Letters beyond U+024F that are no junk.
LEGITIMATE = "ʾʿ‘’“”—–…·"
# The range of letters that are no junk, and the one block beyond it.
JUNK_FROM, ARABIC_FROM, ARABIC_TO = 0x250, 0x600, 0x6FF
# Characters without a glyph.
UNRENDERABLE = r"[\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000B}-\x{001F}\x{007F}-\x{009F}\x{FFF0}-\x{FFFF}]"
# Thresholds and sizes.
JUNK_LINE, JUNK_ITEM = 0.30, 0.08
CHUNK_CHARS, CANDIDATES, TOP_K, RRF_K = 2500, 20, 5, 60
MIN_CONFIDENCE = 0.74
ITEM_MIN_CHARS, ITEM_MAX_CHARS, ITEM_MIN_WORDS = 12, 220, 3
MIN_GROUNDING = 0.35
LENGTH_BANDS = (1.6, 2.4)
DECK_MIN_CHARS, DECK_CHARS_PER_CARD, DECK_MIN_CARDS, DECK_MAX_CARDS = 400, 750, 2, 5
K1, B, EPSILON = 1.5, 0.75, 0.25
BATCH_TOKENS = 32_000

# Folded word -> canonical word, by field.
ALIASES = {
    "wudhu": "wudu",
    "wuzu": "wudu",
    "wudoo": "wudu",
    "ablution": "wudu",
    "ghusal": "ghusl",
    "gusl": "ghusl",
    "tayammom": "tayammum",
    "tayamum": "tayammum",
    "istinja": "istinja",
    "najasah": "najasat",
    "najaasah": "najasat",
    "haid": "haid",
    "hayd": "haid",
    "haiz": "haid",
    "menstruation": "haid",
    "nifaas": "nifas",
    "istihaadah": "istihadah",
    "masah": "masah",
    "mash": "masah",
    "salaat": "salah",
    "salat": "salah",
    "namaz": "salah",
    "namaaz": "salah",
    "prayer": "salah",
    "sajdah": "sajdah",
    "sajda": "sajdah",
    "rakat": "rakah",
    "rakaat": "rakah",
    "rakah": "rakah",
    "ruku": "ruku",
    "adhaan": "adhan",
    "azan": "adhan",
    "iqamah": "iqamah",
    "iqaamah": "iqamah",
    "witir": "witr",
    "taraweeh": "tarawih",
    "taravih": "tarawih",
    "jumuah": "jumuah",
    "juma": "jumuah",
    "jumma": "jumuah",
    "janaza": "janazah",
    "janaazah": "janazah",
    "funeral": "janazah",
    "imamah": "imamah",
    "imaamah": "imamah",
    "sawm": "sawm",
    "saum": "sawm",
    "roza": "sawm",
    "fast": "sawm",
    "iftaar": "iftar",
    "suhoor": "sahur",
    "sehri": "sahur",
    "itikaf": "itikaf",
    "etikaf": "itikaf",
    "kaffaarah": "kaffarah",
    "kafarah": "kaffarah",
    "qadaa": "qada",
    "qazaa": "qada",
    "zakat": "zakah",
    "zakaat": "zakah",
    "zakaah": "zakah",
    "nisaab": "nisab",
    "sadaqah": "sadaqat",
    "fitrah": "fitr",
    "hajj": "hajj",
    "haj": "hajj",
    "umrah": "umrah",
    "umra": "umrah",
    "ihraam": "ihram",
    "tawaaf": "tawaf",
    "saee": "sai",
    "saiy": "sai",
    "qiran": "qiran",
    "tamattu": "tamattu",
    "fardh": "fard",
    "farz": "fard",
    "faraid": "fard",
    "faraidh": "fard",
    "waajib": "wajib",
    "waajibaat": "wajib",
    "wajibat": "wajib",
    "sunnat": "sunnah",
    "sunan": "sunnah",
    "masnun": "sunnah",
    "makruh": "makruh",
    "makrooh": "makruh",
    "makroohat": "makruh",
    "mustahab": "mustahab",
    "mustahabb": "mustahab",
    "adaab": "adab",
    "aadaab": "adab",
    "etiquette": "adab",
    "haraam": "haram",
    "mandoob": "mandub",
}
# Title in the contents -> title in the body.
TITLE_OVERRIDES = {"Sujūd al-tilāwah": "Sajdat al-tilāwah"}
# First page, last page, collection.
COLLECTIONS = ((6, 30, "taharah"), (31, 101, "salah"), (102, 122, "sawm"), (123, 131, "zakah"), (132, 163, "hajj"))
BEFORE_COLLECTIONS, AFTER_COLLECTIONS = "front-matter", "back-matter"
# Folded title -> group, polarity.
GROUPS = {
    "those things which nullify wudu": ("wudu-nullifiers", "affirmative"),
    "those things which do not break wudu": ("wudu-nullifiers", "negative"),
    "things which necessitate ghusl": ("ghusl-necessitate", "affirmative"),
    "things which do not necessitate ghusl": ("ghusl-necessitate", "negative"),
    "chapter regarding those things which nullify salah": ("salah-nullifiers", "affirmative"),
    "things which do not nullify salah": ("salah-nullifiers", "negative"),
    "makruh acts of salah": ("salah-makruh", "affirmative"),
    "those acts which arent makruh in salah": ("salah-makruh", "negative"),
    "chapter on those things which nullify the fast and necessitate kaffarah with qada": ("sawm-nullifiers", "affirmative"),
    "chapter on those things which nullify the fast without necessitating kaffarah": ("sawm-nullifiers", "affirmative"),
    "chapter on those things which do not nullify the fast": ("sawm-nullifiers", "negative"),
    "chapter on offences": ("hajj-penalty", "affirmative"),
    "chapter on those things which do not necessitate a penalty by killing them": ("hajj-penalty", "negative"),
}
# Pattern on the folded title -> category; the first that matches counts.
CATEGORIES = (
    (r"\bdo(es)? not (nullify|break|necessitate)|arent makruh|do not break", "non-nullifier"),
    (r"\bnullify|\bbreak wudu|\bnecessitate", "nullifier"),
    (r"\bfard\b|\bfaraid\b|\bfard actions\b", "fard"),
    (r"\bwajibat\b|\bwajib\b", "wajib"),
    (r"\bsunan\b|\bsunnah\b|\bmasnun\b", "sunnah"),
    (r"\betiquettes?\b|\badab\b", "adab"),
    (r"\bmakruh|\bdisliked\b|\bmustahab", "makruh"),
    (r"\bprerequisites?\b|\bconditions?\b", "shurut"),
)
NO_CATEGORY = "general"
# Categories whose items contrast with each other.
CONTRASTS = (("fard", "wajib", "sunnah", "adab", "makruh", "shurut"), ("nullifier", "non-nullifier"))
# Suffixes in the order in which they are tried, and the stem length.
SUFFIXES, STEM_REST, STEM_CHARS = ("ing", "ment", "ion", "ed", "es", "ly", "s"), 4, 5
# Words that carry no content in items and cards.
STOP_WORDS = tuple(
    "the a an of to in is it and or for on with that this these those which not no be if by as at from does do their there they he she his her its one two when what"
    " who how all any such other into upon over under after before during while even".split()
)
# Words that carry no content in reference answers.
LABEL_STOP_WORDS = tuple(
    "the a an of to in is it and or for on with that this these those which not no are be if by as at from does do their there they he she his her its one two"
    " when what who how whether must may can will would should shall than then also any all some such other into upon over under after before during while".split()
)
# Patterns of questions that ask for a whole list.
LIST_CUES = r"\b(list|enumerate|how many|what are the|which are the|all the|name the)\b"
CATEGORY_CUES = r"\b(fard|fara.?id|wajib|wajibat|sunan|sunnah|adab|etiquette|makruh|disliked|condition|prerequisite|pillar|arkan|nullif|break|invalidat)"
# Pattern of a page named in prose, and the widest range that counts as one.
PAGE_MENTION, PAGE_RANGE = r"\b(?:pp?\.?|pages?)\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?\b", 20
# Patterns of items.
ITEM_START, FOOTNOTE = r"^(\d{1,3})(?:\s*&\s*\d{1,3})?[).]\s*(.+)$", r"^\d{1,3}\s+[A-Z(‘\"]"
GLUED_FOOTNOTE = r"(?<=\p{L})\d{1,2}\b"
SELF_DECLARING = r"\b(is|are)\s+(a\s+)?(fard|farḍ|wajib|wājib|sunnah|sunan|adab|makruh|makrūh|mustahab|mustaḥab|shart|sharṭ|mandub|mandūb)\b"
