"""Study constants, used as parameter defaults."""

# Background control limit; a row is excluded above it.
GST_LIMIT = 500

# IgG cut-offs, positive when strictly greater.
IGG_CUTOFFS = {
    "pfmsp1": 150,
    "ama1": 209,
    "glurp0": 169,
    "csp": 362,
    "hrp2": 337,
    "lsa1": 124,
    "pmmsp1": 550,
    "pomsp1": 362,
    "pvmsp1": 193,
}

# Antigen cut-offs, positive when strictly greater.
ANTIGEN_CUTOFFS = {"hrp2_a": 633, "paldo": 1865, "pldh": 430, "pvldh": 600}

# One net per 1.8 household members is adequate.
NET_ADEQUACY = 0.556

# Age groups in years, left-closed.
AGE3_BREAKS = [0, 5, 10, 15]
AGE7_BREAKS = [0, 3, 5, 7, 9, 11, 13, 14]

# Survey answers 1 yes, 2 no (8 and 9 are missing); three-way water source.
YES_NO = {1: 1, 2: 0}
WATER_SOURCE = {1: 1, 2: 2, 3: 0}

# Roof and wall material ranges as (low, high, low closed, high closed, code).
ROOF_RANGES = [
    (None, 13, True, True, 0),
    (20, 23, False, False, 2),
    (30, 38, False, False, 1),
    (96, 96, True, True, 9),
]
WALL_RANGES = [
    (None, 13, True, True, 0),
    (13, 26, False, False, 2),
    (30, 38, False, False, 1),
    (96, 96, True, True, 9),
]

# Spellings of the species found by PCR, with (Pf, Pm, Po) flags.
SPECIES_FLAGS = {
    "1": (1, 0, 0),
    "2 (Pf Pm)": (1, 1, 0),
    "2 (Pf PO)": (1, 0, 1),
    "2(Pf Pm)": (1, 1, 0),
    "3 (Pf Pm PO)": (1, 1, 1),
    "3 (Pf PM PO)": (1, 1, 1),
    "1 (Pm)": (0, 1, 0),
    "1 (PO)": (0, 0, 1),
    "PO": (0, 0, 1),
    "Pm": (0, 1, 0),
    "2 (Pm PO)": (0, 1, 1),
}

# Sample selection strategy.
SELECTION_CODES = {"Zones": 1, "pAldolase": 2, "pLDH": 2, "pLDH+/HRP2-": 2, "PvLDH": 2}

# Prior bounds of both rates and the penalty per violated bound.
PRIOR_UPPER = 10.0
PRIOR_PENALTY = -1e10

# Flag names where they differ from "<signal>pos" and "<signal>_pos".
FLAG_NAMES = {"glurp0": "glurppos", "hrp2_a": "hrp2_pos"}

# Exported columns of the cleaned person table.
KEEP_COLUMNS = """
ptid varstrat varunit a1qnumber hh_id a1q120 hhwgt ahmember ab_wt ag_wt ahzone ahstate ahlga age
agegrp gender ahtype wealthquintile a1q119 a1q115 a1q108 a1q109 a1q105n a1q105a a1q101a
pfmsp1 pvmsp1 pomsp1 pmmsp1 ama1 glurp0 csp hrp2 lsa1 hrp2_a
pfmsp1pos pmmsp1pos pomsp1pos pvmsp1pos ama1pos glurppos csppos hrp2pos lsa1pos
hrp2_pos pldh_pos pvldh_pos paldo_pos
""".split()
