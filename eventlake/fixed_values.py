"""Fixed values that results depend on."""

# The value lists of the event attributes.
MODELS = ("DX-100", "DX-200", "KR-10", "KR-20", "VM-1", "DX-300",
          "KR-30", "VM-2", "HT-5", "HT-7", "VM-3", "HT-9")
OS_VERSIONS = ("win11", "win10", "macos15", "macos14", "android14", "ios17", "ubuntu22", "macos13")
FIRMWARES = ("2.4.1", "2.4.0", "2.5.0", "2.3.0", "3.0.1")
COUNTRIES = ("US", "IN", "DE", "GB", "FR", "JP", "BR", "CA", "AU", "MX", "ES", "IT", "NL", "SE", "SG")
CONNECTIONS = ("bluetooth", "dongle", "usb")

# Error codes run from 1000, the meaning is item code % 10 of this list.
FIRST_ERROR_CODE = 1000
ERROR_CODE_COUNT = 200
ERROR_MEANINGS = ("connection timeout", "pairing rejected", "update download failed",
                  "sync conflict", "firmware checksum mismatch", "battery too low",
                  "signal lost", "auth token expired", "storage full", "unknown")

# Limits of the payload fields and of late arrival.
BATTERY_RANGE = (5, 100)
RETRIES_RANGE = (0, 3)
MAX_LATE_HOURS = 6

# Layout parameters.
SORT_KEY = ("status", "error_code", "device_model", "event_ts")
TINY_FILES_PER_DAY = 50
RESEND_ONE_IN = 1000

SORTED_ROW_GROUP_BYTES = 16 * 1024 * 1024

# Limits of a governed read.
MAX_WINDOW_DAYS = 31
MAX_ROWS = 1000
MAX_PAIRS = 100_000
SCAN_BUDGET_MB = 10
MAX_RESULT_KB = 256

# List price of a pay-per-scan engine.
USD_PER_TB = 5
MIN_BILLED_MB = 10

# Report batches.
RAW_ROW_GROUP_BYTES = 50_000_000
DEVICE_CLOCK_AHEAD_DAYS = 1
DEVICE_CLOCK_BEHIND_DAYS = 30
