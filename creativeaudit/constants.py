"""Limits, cut-offs and lookup values that decide results.

Everything here is a fixed value: changing one changes verdicts, rejects or
charges. Operators take these as defaults, so a caller can override them.
"""

# ---- fixed values: media limits -------------------------------------------
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MAX_VIDEO_BYTES = 50 * 1024 * 1024
MAX_DURATION_S = 60.0

# ---- fixed values: frame sampling -----------------------------------------
MAX_FRAMES = 6
MIN_FRAME_GAP_S = 0.35
SAME_PICTURE_MAX_MAD = 8.0

# ---- fixed values: verdict rule -------------------------------------------
CONFIDENCE_HIGH = 0.85
CONFIDENCE_MEDIUM = 0.60
DECIDED_BY = "vlm"
BAND_PRECEDENCE = {"absent": 0, "uncertain": 1, "present": 2}

# ---- fixed values: catalog ------------------------------------------------
SLUG_PATTERN = "^[a-z][a-z0-9_]*$"
CATALOG_CAP = 100
SHORT_LABEL = 12

# ---- fixed values: traffic limits -----------------------------------------
KEY_WINDOW_S = 60
IDENTITY_SPAN_S = 60
IDENTITY_LIMIT = 20
LOGIN_LIMIT = 5

# ---- fixed values: scoring a batch ----------------------------------------
SCORER_RETRIES = 4
SCORER_BACKOFF_S = 3

# ---- fixed values: evaluation media ---------------------------------------
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")

# ---- fixed values: wording of label disagreements ---------------------------
POSITIVE_BUT_ABSENT = "labelled POSITIVE, model says absent"
NEGATIVE_BUT_PRESENT = "labelled NEGATIVE, model says present"

# ---- fixed values: wording of the fixture scorer ----------------------------
FIXTURE_SAYS = "fixture says "
FIXTURE_SILENT = "no fixture for this image; answering uncertain"

# ---- fixed values: reject code -> response status --------------------------
ERROR_STATUS = {
    "NOT_CONFIGURED": 409,
    "MISSING_KEY": 401,
    "INVALID_KEY": 401,
    "RATE_LIMITED": 429,
    "UNKNOWN_TAG": 400,
    "NO_TAGS": 400,
    "NO_IMAGE": 400,
    "IMAGE_TOO_LARGE": 413,
    "INVALID_IMAGE": 400,
    "INVALID_IMAGE_URL": 400,
    "VIDEO_TOO_LARGE": 413,
    "VIDEO_TOO_LONG": 413,
    "INVALID_VIDEO": 400,
    "BAD_REQUEST": 400,
    "FORBIDDEN": 403,
    "NOT_FOUND": 404,
    "INFERENCE_WARMING": 503,
    "INFERENCE_FAILED": 502,
    "INTERNAL": 500,
}

# ---- fixed values: display sections of the catalog -------------------------
SECTIONS = [
    ("Restricted", True, ["alcohol", "tobacco_smoking", "vaping", "gambling",
                          "pharma_medicine", "revealing_clothing"]),
    ("Food & drink", False, ["junk_food", "sugary_drinks", "restaurant_dining",
                             "protein_supplements"]),
    ("Health & lifestyle", False, ["gym_fitness", "beauty_cosmetics", "fashion_apparel",
                                   "jewellery", "travel_tourism"]),
    ("Commerce & services", False, ["automotive", "real_estate", "mobile_electronics",
                                    "banking_finance", "education"]),
]
OTHER_SECTION = "Other"

# ---- fixed values: white space at the edges of a text (Unicode White_Space and
# the four ASCII separators) --------------------------------------------------
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# ---- fixed values: characters whose case folding yields ASCII letters but
# whose lower-casing does not (Unicode CaseFolding, status F and C) -----------
CASE_FOLDS = {
    "ß": "ss",
    "ŉ": "ʼn",
    "ſ": "s",
    "ǰ": "ǰ",
    "ẖ": "ẖ",
    "ẗ": "ẗ",
    "ẘ": "ẘ",
    "ẙ": "ẙ",
    "ẚ": "aʾ",
    "ẞ": "ss",
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}

# ---- fixed values: IPv4 networks that are not public (IANA registries) ------
BLOCKED_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
]
ALLOWED_V4 = ["192.0.0.9/32", "192.0.0.10/32"]

# ---- fixed values: IPv6 networks that are not public ------------------------
BLOCKED_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4",
    "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4",
    "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
ALLOWED_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
              "2001:20::/28", "2001:30::/28"]
