"""Words, thresholds and texts the detector is defined by.

Everything in this module is a fixed value: the forest's input columns and the
verdicts only keep their meaning while these stay as they are.  Functions that
use the keyword table take it as an argument, so a stricter table can be passed
without touching the default.
"""

from __future__ import annotations

import sys
import unicodedata

# --- fixed values: keywords looked for in the match text, per flag -----------------

KEYWORDS: dict[str, tuple[str, ...]] = {
    "has_encoded": ("enc", "base64", "encodedcommand"),
    "has_iex": ("iex", "invokeexpression"),
    "has_bypass": ("bypass", "unrestricted"),
    "has_persistence": (
        "schtasks", "scheduledtask", "setitemproperty", "new-itemproperty", "regadd",
    ),
    "has_hidden_window": ("windowstylehidden", "whidden", "windowhidden", "showwindow0"),
    "web": (
        "http", "webclient", "iwr", "restmethod", "bitsadmin", "certutil", "xmlhttp", "msxml2",
    ),
    "download": ("download",),
    "download_method": (".download",),
    "download_folder": ("cd ", ".\\", "dir "),
    "has_reflection": (
        "reflection", "gettype", "getfield", "getmethod", "nonpublic", "::load", "entrypoint",
    ),
    "has_api_calls": (
        "kernel32", "virtualalloc", "writeprocessmemory", "ntdll", "loadlibrary", "marshal",
        "allochglobal", "getasynckeystate", "setwindowshookex", "comobject",
    ),
    "has_lolbins": (
        "bitsadmin", "certutil", "mshta", "regsvr32", "wmic", "csc.exe", "installutil",
    ),
    "api_virtualalloc": ("virtualalloc",),
    "api_createremotethread": ("createremotethread",),
    "has_dllimport": ("dllimport",),
    "crypto": (
        "aesmanaged", "cryptography", "rijndael", "createencryptor", "sha256", "derivebytes",
    ),
    "file_mod": ("writeallbytes", "io.file", "set-content", "out-file"),
    "discovery": ("getchilditem", "gci", "recurse"),
    "shadow_copy": ("vssadmin", "shadowcopy", "shadowstorage"),
    "delete": ("delete",),
    "critical_evasion_alert": (
        "mppreference", "disablerealtime", "exclusionpath", "amsiutils", "amsiinitfailed",
        "disableioavprotection",
    ),
}

CHAR_CODE_MARK = "[char]"

# --- fixed values: the forest's input columns, in order ----------------------------

FEATURE_COLUMNS: tuple[str, ...] = (
    "entropy_log_length",
    "upper_case_ratio",
    "has_encoded",
    "has_iex",
    "has_bypass",
    "has_web_request",
    "has_api_calls",
    "has_persistence",
    "has_hidden_window",
    "has_reflection",
    "has_lolbins",
    "has_char_code",
    "has_string_manipulation",
    "combo_stealth_exploit",
    "combo_bypass_base64",
    "api_virtualalloc",
    "api_createremotethread",
    "has_dllimport",
    "has_vss_purge",
    "combo_ransomware_logic",
    "danger_density",
    "critical_ransomware_alert",
    "critical_evasion_alert",
)
STATISTICAL_COLUMNS = FEATURE_COLUMNS[:2]
FLAG_COLUMNS = tuple(
    name for name in FEATURE_COLUMNS
    if name.startswith(("has_", "api_", "combo_", "critical_"))
)
REPORTED_FLAGS = tuple(
    name for name in FLAG_COLUMNS if not name.startswith("critical_")
)
DETAIL_COLUMNS = tuple(
    name for name in FEATURE_COLUMNS if not name.startswith(("has_", "api_"))
)

# --- fixed values: allow-list ------------------------------------------------------

EVASION_WORDS = ("bypass", "iex", "-enc", "invoke-", "hidden", "powershell")
GIT_PREFIXES = ("git ", "git.exe")
USER_FOLDERS = ("downloads", "desktop")
INSTALLERS = (".exe", ".msi")
SYSTEM_PATHS = ("c:\\windows\\system32", "c:\\program files", "c:\\program files (x86)")
BUILT_IN_COMMANDS = ("cmd.exe", "explorer.exe", "notepad.exe", "calc.exe")
LAUNCH_SOURCE = "UserAssist"
RUNNABLE_SUFFIXES = (".exe", ".ps1", ".vbs", ".bat", ".cmd")
TRUSTED_HASHES = (
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)

# --- fixed values: scores, levels and reason texts ---------------------------------

ALERT_SCORE = 50.0
CRITICAL_SCORE = 80.0
DENSE_FLAGS = 5
DENSE_BONUS = 35.0
LOADER_BONUS = 25.0
OVERRIDE_SCORE = 95.0
MAX_SCORE = 100.0

LEVEL_CRITICAL = "CRITICO"
LEVEL_SUSPECT = "SOSPETTO"
LEVEL_SAFE = "SICURO"

REASON_DENSE = "Danger Density Critica (>=5)"
REASON_RANSOMWARE = "Logica Ransomware Palese"
REASON_LOADER = "Combo Stealth + Rete (Possibile Loader)"
REASON_EVASION = "Tentativo di Evasione Difese (Bypass AV/AMSI)"
REASON_MODEL = "Score assegnato dal Motore ML"
REASON_ALLOWED = "Comando Scartato (Whitelist Dinamica)"
REASON_TRUSTED = "Hash SHA-256 approvato dal team IT (%s...)"

# --- fixed values: sources ---------------------------------------------------------

HISTORY_SOURCE = "Console_History"
EVENT_SOURCE = "PS_Operational.evtx (EID 4104)"
SCRIPT_SOURCE = "Terminale CLI"
PERSISTENCE_SOURCE = "Persistence Trigger (%s)"
STORAGE_SOURCE = "Suspicious Storage (%s\\%s)"
SCRIPT_BLOCK_EVENT = "4104"
SCRIPT_BLOCK_FIELD = "ScriptBlockText"
PERSISTENCE_KEYS = (
    "software\\microsoft\\windows\\currentversion\\run",
    "software\\microsoft\\windows\\currentversion\\runonce",
    "software\\microsoft\\windows\\currentversion\\policies\\explorer\\run",
)
STORAGE_ROOT = "software"
SKIPPED_STORAGE = ("Microsoft", "Classes", "Policies")
STORAGE_WORDS = ("iex", "bypass", "-enc", "powershell")
STORAGE_LENGTH = 500
UNNAMED_VALUE = "(default)"
#: how a value without data reads
NO_DATA = "None"
NO_TIME = "N/D"
BAD_TIME = "Timestamp Errato"
FILE_TIME_SUFFIX = " (File)"

# --- fixed values: text limits -----------------------------------------------------

DATASET_TEXT_LIMIT = 32_000
PREVIEW_LENGTH = 150
MIN_PAYLOAD_TEXT = 5

# --- derived by rule ---------------------------------------------------------------

#: every character that counts as white space when text is stripped
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
#: every decimal digit of any script, with the ASCII digit of the same value
DECIMAL_DIGITS = "".join(
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
DECIMAL_VALUES = "".join(str(unicodedata.decimal(c)) for c in DECIMAL_DIGITS)
