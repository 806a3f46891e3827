"""They must equal the documented ones for results to agree."""

# Header aliases per role. Fixed values.
ALIASES = {
    "id": [
        "numero", "numero etudiant", "numero d etudiant", "no etudiant",
        "no d etudiant", "n etudiant", "num etudiant", "code etudiant",
        "numero d identification", "no d identification", "identifiant",
        "nip", "id", "student id", "studentid",
    ],
    "first_name": ["prenom", "first name", "firstname", "given name"],
    "last_name": [
        "nom", "nom de famille", "last name", "lastname", "surname",
        "family name",
    ],
    "full_name": [
        "nom etu", "nom etudiant", "nom et prenom", "prenom et nom",
        "nom prenom", "prenom nom", "nom complet", "full name", "fullname",
        "etudiant", "student", "name",
    ],
    # "e-mail" normalises to "e mail"; stated here in normal form.
    "email": [
        "email", "e mail", "courriel", "adresse de courriel", "adresse mail",
        "adresse email", "mail",
    ],
    "value": [
        "note", "notes", "grade", "score", "resultat", "mark", "points",
        "note finale", "total", "total general",
    ],
}
ALL_ALIASES = sorted({alias for names in ALIASES.values() for alias in names})

# Value headers that win over every other exact alias. Fixed values.
TOTAL_HEADERS = ["total", "total general"]

# Texts that mean "absent", compared in upper case. Fixed values.
ABSENT_TOKENS = [
    "ABS", "ABSENCE", "ABSENT", "ABJ", "ABI", "DEF", "DEFAILLANT", "DÉFAILLANT",
]

# Cell texts read as null by pandas' readers (public pandas defaults). Fixed values.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Dashes, underscore and apostrophes that become blanks. Fixed values.
SEPARATORS = (
    "-_"
    "\u2010\u2011\u2012\u2013\u2014\u2015"
    "'\u0060\u00b4"
    "\u2018\u2019\u201a\u201b"
    "\u2032\u2035\u02b9\u02bc"
    "\uff07"
)

# Characters that Python and Unicode call white space. Fixed values.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Byte order mark and zero-width characters stripped from header ends. Fixed values.
HEADER_JUNK = "\ufeff\u200b\u200c\u200d"

# A shift sequence of UTF-7; sub-score headers such as "q12". Fixed patterns.
UTF7_PATTERN = r"\+[A-Za-z0-9+/]+-"
QUESTION_PATTERN = r"^q[0-9]+$"

# File extensions read as delimited text and as workbooks. Fixed values.
DELIMITED_EXTENSIONS = [".csv", ".tsv", ".txt"]
WORKBOOK_EXTENSIONS = [".xlsx", ".ods"]

# Rows searched for a header, range and share that make a column look like values.
HEADER_SEARCH_ROWS = 10
CONTENT_RANGE = (0.0, 25.0)
CONTENT_SHARE = 0.5

# Upper bounds of distance / length for the similarity labels. Fixed values.
SIMILARITY_LABELS = [
    (0.15, "very similar (likely typo)"),
    (0.35, "somewhat similar"),
]
SIMILARITY_OTHER = "very different (possibly wrong student)"

# Output headings of the result file. Fixed values.
OUTPUT_ID = "Numéro d'identification"
OUTPUT_EMAIL = "Adresse de courriel"
OUTPUT_FIRST = "Prénom"
OUTPUT_LAST = "Nom de famille"
OUTPUT_VALUE = "Grade"

# Issue code -> severity.
SEVERITY = {
    "dup_roster_id": "info",
    "no_input_files": "warn",
    "unreadable": "warn",
    "no_valid_sheet": "info",
    "saved_sheets_used": "dim",
    "all_sheets_used": "info",
    "no_sheet_selected": "warn",
    "empty_sheet": "warn",
    "override_used": "dim",
    "override_missing": "warn",
    "ambiguous_role": "warn",
    "first_match_used": "info",
    "value_override_used": "dim",
    "value_override_missing": "warn",
    "value_by_prefix": "info",
    "value_ambiguous_prefix": "warn",
    "value_by_content": "info",
    "value_ambiguous_content": "warn",
    "value_none": "info",
    "sheet_no_value_column": "warn",
    "sheet_no_key_column": "warn",
    "sheet_processing": "info",
    "name_mismatch_confirmed_before": "dim",
    "name_mismatch_rejected": "warn",
    "name_mismatch_proceed": "info",
    "id_unknown_try_name": "warn",
    "id_unknown_try_full": "warn",
    "id_unknown_skip": "warn",
    "name_missing": "warn",
    "name_swapped": "info",
    "name_ambiguous": "warn",
    "name_unknown": "warn",
    "full_missing": "warn",
    "full_ambiguous": "warn",
    "full_unknown": "warn",
    "duplicate_claim": "warn",
    "value_empty": "info",
    "value_unparsed": "warn",
    "clamped_saved": "dim",
    "kept_by_choice": "info",
    "kept_undecided": "info",
}
