"""They decide which rows survive and must not drift.

Everything here is data: label domains, thresholds, word lists and patterns.
Patterns are written with Python's meaning of ``\\s \\S \\w \\d`` (Unicode) and
are handed to Spark through :func:`loamsift.functions.regex.java`.
"""

# --- Fixed values: label domains -------------------------------------------
LABELS_COLLECT = ("bug", "enhancement", "documentation", "question", "performance", "refactor")
LABELS_V3 = LABELS_COLLECT
LABELS_FINAL = ("bug", "enhancement", "documentation", "question", "performance")
LABELS_MODEL = ("bug", "documentation", "enhancement", "performance", "question")

LABEL_ALIASES = {
    "bug": ("bug", "bug-report", "type:bug", "kind/bug"),
    "enhancement": ("enhancement", "feature", "feature-request", "type:feature"),
    "documentation": ("documentation", "docs", "doc", "type:docs"),
    "question": ("question", "help", "help-wanted", "type:question"),
    "performance": ("performance", "perf", "speed", "optimization", "optimisation"),
    "refactor": ("refactor", "refactoring", "cleanup", "clean-up", "technical-debt"),
}

PALETTE = (
    "#E05A5A", "#4F8EFF", "#3DD68C", "#F5C842", "#9B7EF5",
    "#F57C42", "#42C8F5", "#F542A7", "#82C45A", "#F5A742",
)
DEFAULT_COLOR = "#888"

# --- Fixed values: thresholds ----------------------------------------------
TARGET_PER_LABEL = 10_000
SHORTFALL_SHARE = 0.7
TOP_REPOS = 600
MIN_STARS = 300
MIN_OPEN_ISSUES = 30
PAGES_PER_ALIAS, ISSUES_PER_PAGE = 10, 100
PAGES_PER_SPEC, REPOS_PER_PAGE = 3, 30
MAX_BODY_CHARS = 10_000
COLLECT_TITLE_WORDS, COLLECT_BODY_WORDS, TEMPLATE_BELOW_WORDS = 4, 30, 80
STRUCTURE_BELOW_CHARS = 200
V3_TITLE_WORDS, V3_BODY_WORDS, V3_HEAD_WORDS, V3_CAP = 3, 20, 350, 3_500
FINAL_TITLE_WORDS, FINAL_BODY_WORDS, FINAL_HEAD_WORDS, FINAL_CAP = 3, 25, 280, 2_500
SPAM_WINDOW_CHARS = 500
SHUFFLE_SEED = 42
TIMELINE_ROWS = 120
TOP_REPORT_ROWS = 10

# What pandas' CSV reader turns into a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: the 40 discovery searches -------------------------------
DISCOVERY_SPECS = (
    "language:javascript stars:>5000 topic:react",
    "language:typescript stars:>3000 topic:frontend",
    "language:javascript stars:>5000 topic:nodejs",
    "language:typescript stars:>3000 topic:vue",
    "language:javascript stars:>3000 topic:angular",
    "language:python stars:>5000 topic:web",
    "language:go stars:>3000 topic:backend",
    "language:java stars:>3000 topic:spring",
    "language:rust stars:>3000",
    "language:ruby stars:>3000 topic:rails",
    "language:php stars:>3000 topic:laravel",
    "language:python stars:>5000 topic:deep-learning",
    "language:python stars:>5000 topic:machine-learning",
    "language:python stars:>3000 topic:pytorch",
    "language:python stars:>3000 topic:tensorflow",
    "language:python stars:>3000 topic:data-science",
    "language:jupyter-notebook stars:>3000",
    "language:go stars:>5000 topic:kubernetes",
    "topic:docker stars:>5000",
    "topic:terraform stars:>3000",
    "language:python stars:>3000 topic:devops",
    "topic:ansible stars:>2000",
    "language:swift stars:>2000 topic:ios",
    "language:dart stars:>3000 topic:flutter",
    "language:kotlin stars:>2000 topic:android",
    "language:rust stars:>2000 topic:cli",
    "language:go stars:>2000 topic:cli",
    "language:c stars:>5000",
    "language:cpp stars:>5000",
    "topic:database stars:>3000",
    "topic:postgresql stars:>2000",
    "topic:redis stars:>3000",
    "topic:security stars:>2000",
    "topic:cryptography stars:>2000",
    "topic:testing stars:>2000",
    "topic:linting stars:>2000",
    "topic:documentation stars:>3000",
    "stars:>15000 topic:framework",
    "stars:>10000 topic:library",
    "stars:>8000 topic:open-source",
)

# --- Fixed values: word lists ----------------------------------------------
TEMPLATE_PHRASES = (
    "describe your issue", "describe the bug", "steps to reproduce",
    "expected behavior", "actual behavior", "please describe",
    "your description here", "fill in the", "<!-- please",
    "<!---", "[ ] bug", "[x] bug", "type: bug", "**describe",
    "**expected", "**actual", "**steps", "**environment",
)

STOP_WORDS_FINAL = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "の", "に", "は", "を", "た", "が", "で", "て", "と", "し",
    "이", "가", "을", "는", "에", "의", "로", "하", "한", "합",
    "не", "на", "это", "то", "но", "из", "по", "он", "она", "как",
    "que", "una", "por", "con", "del", "los", "las", "para",
    "qui", "une", "sur", "les", "des", "est", "dans", "avec",
    "ich", "sie", "nicht", "das", "und", "ein", "ist", "mit",
)
STOP_WORDS_COLLECT = STOP_WORDS_FINAL + ("não", "uma", "com", "para", "são", "isso", "esse")
STOP_WORDS_V3 = STOP_WORDS_COLLECT + ("está", "pas", "den")

# --- Fixed values: bot and spam patterns -----------------------------------
BOT_LOGIN = (
    r"(?iu)dependabot|renovate\[bot\]|greenkeeper|snyk-bot|allcontributors"
    r"|github-actions\[bot\]|imgbot|stale\[bot\]|codecov|mergify"
    r"|restyled-io|lgtm-com|sonarcloud|whitesource|deepsource"
    r"|semantic-release-bot|github-actions"
)
BOT_MENTION = (
    r"(?iu)dependabot|renovate\[bot\]|greenkeeper|snyk-bot"
    r"|github-actions\[bot\]|imgbot|stale\[bot\]|codecov"
)
API_SPAM = r"(?iu)##\s*api\s*(submission|information)|\*\*api\s*(name|url)\*\*|api\s+url\s*:"

# --- Fixed values: cleaning patterns ---------------------------------------
# Repeats that can only match one way are possessive, starts inside an already
# refused run are skipped (``\G`` / look-behind) and a leading look-ahead refuses
# most characters at once: same matches, but no deep recursion and no quadratic
# time on very long texts.
CRLF = r"\r\n|\r"
SPACES = r"[ \t]+"
BLANK_LINES = r"\n{3,}"
HTML_COMMENT = r"<!--(?s:.)*?-->"
HTML_TAG = r"<[^>]{1,300}>"
HTML_ENTITY = r"&[a-zA-Z]{2,8};|&#?\w{1,8};"
MD_IMAGE = r"!\[[^\]]*\]\([^\)]*\)"
MD_LINK = r"\[([^\]]+)\]\([^\)]+\)"
MD_BOLD = r"\*{1,3}([^*\n]{1,200}?)\*{1,3}"
MD_STRIKE = r"~~([^~\n]+)~~"
MD_HEADER = r"(?md)^#{1,6}\s+"
MD_RULE = r"(?md)^[-*_]{3,}\s*$"
MD_TABLE = r"(?md)^\|.*\|.*$"
MD_QUOTE = r"(?md)^(?:\G|(?<!\n\n))\s*>\s+"
MD_LIST = r"(?md)^(?:\G|(?<!\n\n))\s*[-*+]\s+"
MD_NUMBERED = r"(?md)^(?:\G|(?<!\n\n))\s*\d+\.\s+"
CHECKBOX = r"(?md)^[-*]\s*\[[ xX]\][^\n]*$"
CODE_BLOCK = r"```(?s:.)*?```"
INLINE_CODE = r"`[^`\n]{1,300}`"
URL = r"https?://\S+|www\.\S+"
ISSUE_REF = r"#\d+"
VERSION = r"(?=[v\d])(?<!\w)v?\d+\.\d+[\.\d\-\w]*\b"
FILE_SUFFIX = (
    r"\.(?:js|ts|py|java|go|rb|rs|cpp|c|h"
    r"|jsx|tsx|vue|css|html|json|yaml|yml|xml|md|sh|swift|kt|dart)(?!\w)"
)
FILE_PATH = r"(?:/[\w.\-]++){2,}+|(?:\G|(?<![\w\-]))[\w\-]++" + FILE_SUFFIX
HEX_FROM_7 = r"(?=[0-9a-f]{7})(?<!\w)[0-9a-f]{7,40}(?!\w)"
HEX_FROM_8 = r"(?=[0-9a-f]{8})(?<!\w)[0-9a-f]{8,40}(?!\w)"
TRACE_V3 = (
    r"Traceback \(most recent call last\)(?s:.)*?(?=\n\n|\z)"
    r"|Exception in thread(?s:.)*?(?=\n\n|\z)"
    r"|(?![!-~])(?:\G|(?<!\s))(?:\s++at [\w\.$<>]+\([\w\.]+:\d+\)\n){3,}+"
)
TRACE_FINAL = (
    r"Traceback \(most recent call last\)(?s:.)*?(?=\n\n|\z)"
    r"|(?![!-~])(?:\G|(?<!\s))\s++at [\w\.$<>]+\([\w\.]+:\d+\)"
    r"|Exception in thread(?s:.)*?(?=\n\n|\z)"
)
LOG_LINE = r"(?md)^\[?\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}[^\n]*$"
TEMPLATE_HEADER = (
    r"(?imdu)^#{1,4}\s*(version|reproduction\s*link?|steps\s+to\s+reproduce"
    r"|minimal\s+repro(?:duction)?|what\s+is\s+expected|what\s+is\s+actually"
    r"|expected\s+behav|actual\s+behav|environment|platform|system\s+info"
    r"|additional\s+context|describe\s+the\s+bug|to\s+reproduce)[^\n]*"
)
PLACEHOLDER = (
    r"(?iu)\[\s*(?:CODE|INLINE_CODE|CODE_BLOCK|URL|VERSION|FILEPATH|"
    r"HASH|STACKTRACE|INLINE CODE|CODE BLOCK)\s*\]"
)
PLACEHOLDER_LEAK = r"\[(CODE|URL|VERSION|FILEPATH|HASH)\]"
DIVIDER = r"[-=*_~`]{4,}"
PUNCT_RUN_V3 = r"[!?.,-]{2,}([!?.,-])"
PUNCT_RUN_FINAL = r"[!?.]{2,}([!?.])"
TITLE_SQUARE_PREFIX = r"^\s*\[[^\]]{1,25}\]\s*"
TITLE_ROUND_PREFIX = r"^\s*\([^\)]{1,20}\)\s*"
TITLE_ANY_PREFIX = r"^\s*[\[\(][^\]\)]{1,20}[\]\)]\s*[:\-]?\s*"
TITLE_ANY_SQUARE = r"\[[^\]]{1,25}\]"
