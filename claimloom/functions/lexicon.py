"""Lexicons: data that callers may replace."""

# Bias patterns as (severity, category, patterns). Each counts as a whole phrase.
BIAS = [
    ("High", "superlative", [r"\bbest\b", r"\bworst\b", r"\btop\b", r"\b#1\b", r"\bunbeatable\b", r"\bunmatched\b", r"\bunrivaled\b", r"\bperfect\b", r"\bultimate\b", r"\bsupreme\b"]),
    ("High", "guarantee", [r"\bguaranteed?\b", r"\bensures?\b", r"\bwill\s+always\b", r"\bnever\s+fails?\b", r"\bcertain(ly)?\b", r"\bproven\b"]),
    ("High", "medical", [r"\bcures?\b", r"\bheals?\b", r"\btreats?\b", r"\bmedically\s+proven\b", r"\bclinically\s+proven\b", r"\bdiagnose\b", r"\bprevents?\s+disease\b"]),
    ("High", "financial", [r"\bguaranteed\s+returns?\b", r"\brisk.free\b", r"\bwill\s+increase\b", r"\bdouble\s+your\b", r"\bFDIC\s+insured\b"]),
    ("Medium", "exaggeration", [r"\bamazing\b", r"\bincredible\b", r"\bunbelievable\b", r"\bextraordinary\b", r"\bphenomenal\b", r"\bspectacular\b", r"\blife.?changing\b", r"\brevolutionary\b"]),
    ("Medium", "absolute", [r"\balways\b", r"\bnever\b", r"\beveryone\b", r"\beverybody\b", r"\ball\s+users?\b", r"\bcompletely\b", r"\btotally\b", r"\b100%\b", r"\bevery\s+time\b"]),
    ("Low", "comparative", [r"\bbetter\s+than\b", r"\bsuperior\s+to\b", r"\boutperforms?\b", r"\bexceeds?\b", r"\bleading\b", r"\btop.?rated\b"]),
]

# Over-claiming phrases.
OVERCLAIMS = [
    r"\bbest\b", r"\bworst\b", r"\bgreatest\b", r"\bperfect\b", r"\bultimate\b", r"\bsupreme\b", r"\bunbeatable\b", r"\bunmatched\b",
    r"\bunrivaled\b", r"\bunparalleled\b", r"\bincredible\b", r"\bamazing\b", r"\beveryone\b", r"\balways\b", r"\bnever\b", r"\bguaranteed?\b",
    r"\bproven\b", r"\bcertified\b", r"\bmedically\b", r"\bclinically\b", r"\b#1\b", r"\btop.rated\b", r"\bleading\b", r"\bmarket.leader\b",
]

# Trigger words and patterns of claims.
CLAIM_VERBS = [
    "is", "are", "has", "have", "provides", "offers", "includes", "contains", "features", "ensures", "guarantees", "supports", "reduces",
    "increases", "improves", "enhances", "designed to", "helps", "delivers", "enables", "allows", "achieves", "maintains", "prevents", "protects",
]
GUARANTEE = [
    "guaranteed", "guarantee", "always", "never", "100%", "proven", "certified", "clinically proven", "scientifically proven", "lab-tested",
    "instant", "immediate", "overnight", "permanent", "forever", "eliminate", "cure",
]
MEDICAL = ["treat", "treats", "cure", "cures", "heal", "heals", "diagnose", "diagnoses", "prevent", "prevents", "disease", "disorder", "condition", "illness"]
FINANCIAL = ["invest", "investment", "returns", "profit", "earnings", "yield", "guaranteed return", "risk-free", "no risk", "secure investment"]
NUMERIC = r"(?i)\b\d+\.?\d*\s*(?:mg|g|kg|ml|l|gb|mb|hz|mhz|ghz|fps|years?|months?|days?|hours?|minutes?|seconds?|%|percent|dollars?|\$|€|£|USD|EUR|GBP|IP\d+)\b"
COMPARATIVE = r"\b(better|faster|more|less|superior|best|#1|number one|leading|top)\b"

# Claim categories by substring, the first that fits wins.
CATEGORIES = [
    ("display", ["display", "screen", "inch", '"', "oled", "lcd", "amoled", "refresh rate", "hz", "resolution", "brightness", "nits"]),
    ("camera", ["camera", "mp", "megapixel", "photo", "lens", "zoom", "aperture", "ois", "image stabilization", "ultrawide", "telephoto", "video recording"]),
    ("ram", ["ram", "lpddr"]),
    ("storage", ["storage", "ufs", "expandable", "microsd"]),
    ("battery", ["battery", "mah", "charging", "power", "watt", "fast charging", "wireless charging"]),
    ("processor", ["processor", "cpu", "chipset", "ghz", "core", "gpu", "npu", "tensor", "snapdragon", "exynos"]),
    ("network", ["5g", "4g", "lte", "wifi", "wi-fi", "bluetooth", "cellular", "connectivity", "nfc", "sub-6"]),
    ("dosage", ["mg", "dose", "dosage", "serving", "tablet", "capsule", "pill", "take", "consume"]),
    ("ingredients", ["contain", "ingredient", "gluten", "soy", "dairy", "allergen", "vegan", "vegetarian", "non-gmo", "fish", "formulation", "extract", "blend"]),
    ("safety", ["safe", "side effect", "drowsiness", "warning", "caution", "pregnant", "children", "adult", "age", "habit", "addictive", "dependency"]),
    ("manufacturing", ["manufactured", "facility", "gmp", "tested", "quality", "certified", "third-party", "purity", "potency"]),
    ("regulatory", ["fda", "approved", "evaluated", "regulated", "drug", "supplement", "dshea", "clinically", "proven"]),
    ("efficacy", ["help", "support", "promote", "improve", "enhance", "treat", "cure", "prevent", "reduce", "sleep", "insomnia", "rest", "relax", "wake", "rhythm", "cycle", "pattern", "onset"]),
    ("storage_temp", ["store", "storage", "temperature", "°c", "degrees", "room temperature", "cool", "dry", "freeze", "heat", "light"]),
    ("consensus", ["proof of stake", "pos", "validator", "staking", "consensus", "block"]),
    ("supply", ["supply", "coin", "token", "issuance", "inflation", "deflationary"]),
    ("transaction", ["transaction", "tps", "per second", "speed", "throughput", "latency"]),
    ("security", ["security", "encryption", "hash", "cryptographic", "secure"]),
    ("energy", ["energy", "power", "consumption", "efficient", "green", "carbon"]),
]

# Violation types by substring, in order; else Factual.
VIOLATION_TYPES = [
    ("Numerical", ["gb", "mp", "mg", "tablets", "seconds", "ppm", "°c", "w "]),
    ("Feature hallucination", ["not supported", "not mentioned", "cannot", "does not"]),
    ("Logical contradiction", ["contradicts", "cannot be both", "mutually exclusive"]),
]

# Markers of prompts and of generated texts.
PROMPT_MARKERS = [
    "you are an elite content marketing strategist", "you are writing", "your mission:", "compliance framework", "authorized claims", "prohibited claims",
    "mandatory disclaimers", "output format", "before writing, mentally confirm", "hard rules:", "use only the information provided below", "do not invent or infer",
]
OUTPUT_MARKERS = ["experience the", "discover", "introducing the", "## ", "headline:", "primary text:", "description:", "**q"]

# Numbers with a unit of a closed list.
NUMBER_WITH_UNIT = r'(?i)(\d+(?:\.\d+)?)\s*(GB|MB|TB|inch|"|mAh|MP|Hz|W|mm|grams?|kg|℃|°C|C)\b'

#: Units: name, dimension, factor and offset to the dimension's base unit.
UNITS = [
    ("mg", "mass", 1e-6, 0.0), ("g", "mass", 1e-3, 0.0), ("gram", "mass", 1e-3, 0.0), ("grams", "mass", 1e-3, 0.0), ("kg", "mass", 1.0, 0.0),
    ("mm", "length", 1e-3, 0.0), ("cm", "length", 1e-2, 0.0), ("m", "length", 1.0, 0.0), ("inch", "length", 0.0254, 0.0), ("in", "length", 0.0254, 0.0),
    ("s", "time", 1.0, 0.0), ("seconds", "time", 1.0, 0.0), ("minutes", "time", 60.0, 0.0), ("hours", "time", 3600.0, 0.0), ("days", "time", 86400.0, 0.0),
    ("kb", "data", 1e3, 0.0), ("mb", "data", 1e6, 0.0), ("gb", "data", 1e9, 0.0), ("tb", "data", 1e12, 0.0),
    ("hz", "frequency", 1.0, 0.0), ("mhz", "frequency", 1e6, 0.0), ("ghz", "frequency", 1e9, 0.0), ("ml", "volume", 1e-3, 0.0), ("l", "volume", 1.0, 0.0),
    ("k", "temperature", 1.0, 0.0), ("c", "temperature", 1.0, 273.15), ("f", "temperature", 5 / 9, 255.3722222222222),
]
