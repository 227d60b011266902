"""Lists, tables and patterns results must agree on."""

from __future__ import annotations

# --- fixed values: text cleaning -------------------------------------------
TEXT_COLUMNS = ["ProductCD", "DeviceInfo", "id_31", "P_emaildomain", "R_emaildomain"]
NUMERIC_COLUMNS = [
    "TransactionAmt", "TransactionDT", "addr1", "addr2", "card1", "card2", "card3", "card5",
]
EMAIL_COLUMNS = ["P_emaildomain", "R_emaildomain"]
EMAIL_SENTINELS = ["email_not_provided", "unknown"]
MATCH_COLUMNS = [f"M{i}" for i in range(1, 10)]
MATCH_CODES = {"T": 1, "F": 0, "t": 1, "f": 0, "M0": 0, "M1": 1, "M2": 2}

# --- fixed values: column selection ----------------------------------------
OPAQUE_KEEP = [
    1, 3, 4, 6, 8, 11, 13, 14, 17, 20, 23, 26, 27, 30, 36, 37, 40, 41, 44, 47, 48, 54, 56, 59,
    62, 65, 67, 68, 70, 76, 78, 80, 82, 86, 88, 89, 91, 107, 108, 111, 115, 117, 120, 121, 123,
    124, 127, 129, 130, 136, 138, 139, 142, 147, 156, 160, 162, 165, 166, 169, 171, 173, 175,
    176, 178, 180, 182, 185, 187, 188, 198, 203, 205, 207, 209, 210, 215, 218, 220, 221, 223,
    224, 226, 228, 229, 234, 235, 238, 240, 250, 252, 253, 257, 258, 260, 261, 264, 266, 267,
    271, 274, 277, 281, 283, 284, 285, 286, 289, 291, 294, 296, 297, 301, 303, 305, 307, 309,
    310, 314, 320,
]
UNSTABLE_COLUMNS = [
    "C3", "M5", "id_08", "id_33", "card4", "id_07", "id_14", "id_21", "id_30", "id_32", "id_34",
    "id_22", "id_23", "id_24", "id_25", "id_26", "id_27",
    "D6", "D7", "D8", "D9", "D12", "D13", "D14",
]

# --- fixed values: e-mail ---------------------------------------------------
RISKY_DOMAINS = [
    "anonymous.com", "mailinator.com", "tempmail.com", "dispostable.com",
    "yopmail.com", "10minutemail.com", "guerrillamail.com",
]
GENERIC_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com"]
HIGH_RISK_DOMAINS = [
    "protonmail.com", "guerrillamail.com", "mailinator.com", "10minutemail.com",
    "tempmail.com", "throwaway.email", "yopmail.com", "sharklasers.com",
    "guerrillamail.info", "dispostable.com", "trashmail.com",
]
DISPOSABLE_PATTERN = "temp|disposable|guerrilla|throwaway|fake|spam|trash"
FREE_COMPANIES = ["GOOGLE", "YAHOO", "MICROSOFT", "AOL"]
US_SUFFIXES = ["gmail", "net", "edu"]
# Domains of each mail company; every other domain is OTHER.
EMAIL_COMPANIES = {
    "GOOGLE": ["gmail.com", "googlemail.com"],
    "ATT": ["att.net", "sbcglobal.net", "prodigy.net.mx"],
    "SPECTRUM": ["twc.com", "charter.net"],
    "MICROSOFT": [
        "hotmail.co.uk", "hotmail.com", "hotmail.de", "hotmail.fr", "hotmail.es", "live.com",
        "live.fr", "live.com.mx", "msn.com", "outlook.com", "outlook.es",
    ],
    "YAHOO": [
        "yahoo.com", "yahoo.com.mx", "yahoo.fr", "yahoo.es", "yahoo.co.jp", "yahoo.de",
        "yahoo.co.uk", "ymail.com", "rocketmail.com", "verizon.net", "frontier.com",
        "frontiernet.net",
    ],
    "APPLE": ["me.com", "mac.com", "icloud.com"],
    "AOL": ["aim.com", "aol.com"],
    "CENTURYLINK": ["centurylink.net", "embarqmail.com", "q.com"],
}

# --- fixed values: device ---------------------------------------------------
# Maker of a device text; the last matching rule wins.
DEVICE_MAKERS = [
    ("huawei|honor", "HUAWEI"),
    ("os", "APPLE"),
    ("idea|ta", "LENOVO"),
    ("moto|xt|edison", "MOTOROLA"),
    ("mi|redmi", "XIAOMI"),
    ("vs|lg|ego", "LG"),
    ("one touch|alcatel", "ALCATEL"),
    ("one a", "ONEPLUS"),
    ("opr6", "HTC"),
    ("nexus|pixel", "GOOGLE"),
    ("stv", "BLACKBERRY"),
    ("asus", "ASUS"),
    ("blade", "ZTE"),
]
SAMSUNG_CODES = ["rv", "SM", "GT", "SGH"]
DEVICE_PREFIXES = [("Z", "ZTE"), ("KF", "AMAZON"), ("D", "SONY"), ("E", "SONY"),
                   ("F", "SONY"), ("G", "SONY")]
DEVICE_FLAGS = {
    "device_iphone": "iphone|ios",
    "device_ipad": "ipad",
    "device_samsung": "samsung|sm-",
    "device_huawei": "huawei",
    "device_lg": r"\blg\b",
    "device_motorola": "moto|motorola",
    "device_xiaomi": "xiaomi|mi |redmi",
    "device_oneplus": "oneplus",
    "device_google": "pixel|nexus",
    "device_windows": "windows",
    "device_macos": "macos|mac os",
    "device_linux": "linux",
    "device_generic_android": "android",
}
PREMIUM_DEVICES = ["device_iphone", "device_ipad", "device_samsung"]
FAKE_SCREENS = ["360x640", "800x600", "1024x768", "320x480", "480x800"]
MODERN_SCREENS = ["2340x1080", "2960x1440", "2220x1080", "1920x1080", "2400x1080"]
HIGH_RES_PIXELS = 2_000_000

# --- fixed values: encodings ------------------------------------------------
SHARE_COLUMNS = [
    "ProductCD", "card1", "card2", "card3", "card4", "card5", "card6",
    "addr1", "addr2", "P_emaildomain", "R_emaildomain", "card1_addr1",
]
TARGET_COLUMNS = [
    "P_emaildomain", "R_emaildomain", "DeviceInfo", "DeviceType", "card4", "card6", "ProductCD",
] + [f"id_{i}" for i in (12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)]
TARGET_SMOOTHING = 10

# --- fixed values: account takeover and rules --------------------------------
PROFILE_RISKY_DOMAINS = [
    "anonymous.com", "mailinator.com", "tempmail.com", "dispostable.com", "yopmail.com",
    "10minutemail.com", "guerrillamail.com", "protonmail.com", "sharklasers.com",
    "guerrillamail.info", "trashmail.com",
]
PROFILE_EMAIL_PATTERN = "temp|disposable|fake|trash|spam|10minute"
PROFILE_DEVICE_PATTERN = "emulator|bot|crawler|scraper|unknown"
RULE_RISKY_DOMAINS = [
    "anonymous.com", "mailinator.com", "tempmail.com", "10minutemail.com", "guerrillamail.com",
]
