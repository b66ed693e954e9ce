"""Fixed values.

Every constant here must equal the behaviour being matched (patterns,
dictionaries of rewrites, cut-offs, labels, prompt text). They are stated
plainly, in natural order, in one place; the code elsewhere only refers to
them by name.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Whitespace as understood by Python's str.isspace()/re ``\s`` (Unicode),
# written as a regex character class usable by both Java regex and RE2.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Cased letters (Python's title(): a word is a run of cased letters).
CASED_CLASS = r"\p{Lu}\p{Ll}\p{Lt}"
# The same with the letters that are cased by property alone (ª, ⅷ, ⓐ, ʰ), as
# Java's regex names them.
CASED_BY_PROPERTY = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"

# Letters whose title case is neither their upper nor lower case (Latin
# digraphs): any case of the digraph -> its title-case form.
TITLECASE_DIGRAPHS = {
    "Ǆ": "ǅ", "ǅ": "ǅ", "ǆ": "ǅ",
    "Ǉ": "ǈ", "ǈ": "ǈ", "ǉ": "ǈ",
    "Ǌ": "ǋ", "ǋ": "ǋ", "ǌ": "ǋ",
    "Ǳ": "ǲ", "ǲ": "ǲ", "ǳ": "ǲ",
}

# Program/university split separators (rule-based fallback).
SPLIT_SEPARATORS = r",| at | @ "

# Inline expansions of the rule-based fallback (full match, case-free).
FALLBACK_UNI_EXPANSIONS = [
    (r"(?i)mcg(ill)?(\.)?", "McGill University"),
    (r"(?i)(ubc|u\.?b\.?c\.?|university of british columbia)",
     "University of British Columbia"),
]

# University abbreviations: ordered, full match, first hit wins.
ABBREV_UNI = [
    (r"(?i)^mcg(\.|ill)?$", "McGill University"),
    (r"(?i)^(ubc|u\.?b\.?c\.?)$", "University of British Columbia"),
    (r"(?i)^uoft$", "University of Toronto"),
]

# Exact, case-sensitive spelling fixes.
COMMON_UNI_FIXES = {
    "McGiill University": "McGill University",
    "Mcgill University": "McGill University",
    "University Of British Columbia": "University of British Columbia",
}
COMMON_PROG_FIXES = {
    "Mathematic": "Mathematics",
    "Info Studies": "Information Studies",
}

# Fuzzy-match cut-offs (ratio of matching characters).
PROGRAM_CUTOFF = 0.84
UNIVERSITY_CUTOFF = 0.86

# Value domains of the badges.
SEMESTER_PATTERN = r"^(Fall|Spring|Summer|Winter)" + WS_CLASS + r"+\d{4}"
CITIZENSHIP_VALUES = ["International", "American", "Other"]

# Record-start marker: an element carrying all three classes.
RECORD_START_CLASSES = ["tw-font-medium", "tw-text-gray-900", "tw-text-sm"]
BADGE_CLASS = "tw-inline-flex"

# Result cap of the ranked questions.
DEFAULT_LIMIT = 100
MAX_LIMIT = 100

# Question literals (defaults of the parameterised questions).
DEFAULT_TERM = "Fall 2026"
DEFAULT_YEARS = ["2026", "2025"]
TOP_SCHOOL_PATTERNS = [
    "%Georgetown%",
    "%Massachusetts Institute of Technology%",
    "%MIT%",
    "%Stanford%",
    "%Carnegie Mellon%",
]

# Report labels, one per question.
QUESTION_LABELS = {
    "q1": "Q1 — Fall 2026 Entries",
    "q2": "Q2 — International Students",
    "q3": "Q3 — Average Applicant Scores",
    "q4": "Q4 — Avg GPA of American Students (Fall 2026)",
    "q5": "Q5 — Fall 2026 Acceptance Rate",
    "q6": "Q6 — Avg GPA of Fall 2026 Acceptances",
    "q7": "Q7 — JHU Masters CS",
    "q8": "Q8 — Top School PhD CS Acceptances (2026)",
    "q9": "Q9 — Same Query Using LLM Generated Fields",
    "q10": "Q10 — PhD Rejection Rate: 2025 vs 2026",
    "q11": "Q11 — Accepted vs Rejected PhD GPA (2026)",
}
MISSING_TEXT = "—"
MISSING_SCORE_TEXT = "N/A"

# Standardiser prompt: system text and few-shot pairs.
SYSTEM_PROMPT = (
    "You are a data cleaning assistant. Standardize degree program and university "
    "names.\n\n"
    "Rules:\n"
    "- Input provides both the university and the program under the keys `university` and `program`, respectively\n"
    "- Split into (university name, program name, ).\n"
    "- Trim extra spaces and commas.\n"
    '- Expand obvious abbreviations (e.g., "McG" -> "McGill University", '
    '"UBC" -> "University of British Columbia").\n'
    "- Use Title Case for program; use official capitalization for university "
    "names (e.g., \"University of X\").\n"
    '- Ensure correct spelling (e.g., "McGill", not "McGiill").\n'
    '- If the univerisity cannot be determined, look explicitly\n'
    'at the "university" member. Using that member, determine correct\n'
    'spelling, if needed.\n'
    '    - If the university name is not explicitly stated,\n'
    'return "Unknown".\n'
    '    - If multiple universities are possible, return "Unknown".\n\n'
    "Return JSON ONLY with keys:\n"
    "  standardized_program, standardized_university\n"
)
FEW_SHOTS = [
    ({"university": "McGill University", "program": "Information Studies"},
     {"standardized_university": "McGill University",
      "standardized_program": "Information Studies"}),
    ({"university": "McG", "program": "Information"},
     {"standardized_university": "McGill University",
      "standardized_program": "Information Studies"}),
    ({"university": "University Of British Columbia", "program": "Mathematics"},
     {"standardized_university": "University of British Columbia",
      "standardized_program": "Mathematics"}),
    ({"university": "Harvard", "program": "Computer Science"},
     {"standardized_university": "Harvard University",
      "standardized_program": "Computer Science"}),
]

# Task kinds handled by the worker.
# ------------------------------------------------------------ end fixed values
