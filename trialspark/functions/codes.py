"""Fixed values that must equal the study's definitions.

Kept together and in their natural order; nothing here is derived.
"""

# --- fixed values: ICD-10 codes for antimicrobial resistance (hospital outcome 1).
# The study lists U830 twice; a set keeps one.
RESISTANCE_CODES = (
    "U820", "U821", "U822", "U828", "U829", "U830", "U831", "U832", "U837", "U838",
    "U839", "U847", "U848", "U849", "U800", "U801", "U808", "U810", "U818", "U890",
    "U898", "U899", "U880",
)

# --- fixed values: substrings marking a urinary tract infection diagnosis (hospital outcome 2).
UTI_CODE_PATTERNS = ("N10", "N12", "N300", "N308", "N309", "N390")

# --- fixed values: antibiotic result columns of a urine test, value tested.
RESISTANT = "Resistant"
RESISTANCE_COLUMNS = (
    "trimethoprim", "nitrofurantoin", "cephalexin", "coamoxiclav", "amoxicillin",
    "pivmecillinam", "fosfomycin", "ciprofloxacin", "amoxicillin_clavulanate",
)
# Columns counted for "two or more resistances"; the two co-amoxiclav columns count once.
MULTI_RESISTANCE_GROUPS = (
    ("trimethoprim",),
    ("nitrofurantoin",),
    ("amoxicillin",),
    ("amoxicillin_clavulanate", "coamoxiclav"),
    ("cephalexin",),
    ("pivmecillinam",),
    ("fosfomycin",),
    ("ciprofloxacin",),
)

# --- fixed values: urine culture outcomes, best first (rank 1..6), and their baseline indicator.
UTI_OUTCOME_RANK = (
    "Confirmed UTI",
    "Possible UTI",
    "Heavy mixed growth",
    "Mixed growth",
    "No microbiological evidence of UTI",
    "Exclude NULL culture",
)
# indicator by rank: 1,2 -> 1; 3,4 -> 2; 5,6 -> 0 (the code) or 3 (the comment)
URINE_INDICATOR_BY_RANK = {1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0}
URINE_INDICATOR_NO_EVIDENCE_DOCUMENTED = 3

# --- fixed values: exit reasons.
REASON_12M = "DG +12mths"
REASON_LTF = "LTF"
REASON_DIED = "DIED"
REASON_STUDY_END = "STUDY END"
REASON_NEW = "NEW PABX"

# --- fixed values: source tags of UTI episodes (primary care / hospital) in the data_source column.
GP_SOURCE = "WLGP"
HOSPITAL_SOURCE = "PEDW"

# --- fixed values: far-future date used in place of a missing end date.
OPEN_END = "2099-01-31"
