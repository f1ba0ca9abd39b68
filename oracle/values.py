"""The oracle's own fixed values: a wrong list on the engine's side must not pass both."""

# --- fixed values: diagnosis codes for antimicrobial resistance.
RESISTANT_CODES = [
    "U800", "U801", "U808", "U810", "U818", "U820", "U821", "U822", "U828", "U829", "U830", "U831", "U832",
    "U837", "U838", "U839", "U847", "U848", "U849", "U880", "U890", "U898", "U899",
]

# --- fixed values: parts of a diagnosis code that mark a urinary tract infection.
UTI_PARTS = ["N10", "N12", "N300", "N308", "N309", "N390"]

# --- fixed values: antibiotics of a urine test; names on one line are one drug.
DRUGS = [
    ["trimethoprim"],
    ["nitrofurantoin"],
    ["cephalexin"],
    ["amoxicillin"],
    ["coamoxiclav", "amoxicillin_clavulanate"],
    ["pivmecillinam"],
    ["fosfomycin"],
    ["ciprofloxacin"],
]

# --- fixed values: urine culture results, best first, and the indicator of each.
CULTURES = [
    ("Confirmed UTI", 1),
    ("Possible UTI", 1),
    ("Heavy mixed growth", 2),
    ("Mixed growth", 2),
    ("No microbiological evidence of UTI", 0),
    ("Exclude NULL culture", 0),
]

# --- fixed values: exit reasons.
TWELVE_MONTHS, LEFT, DIED, STUDY_END, NEW = "DG +12mths", "LTF", "DIED", "STUDY END", "NEW PABX"
