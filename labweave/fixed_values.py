"""Lookup tables, name maps and published constants.

Nothing here is computed; the values must stay as they are for results to agree.
"""

# --- fixed values: material -> (formation energy, density) -------------------
MATERIALS = {
    "Ni": (0.046, 9.22),
    "Co": (0.025, 9.2),
    "ReOx": (0.004, 20.87),
    "Ru": (0.131, 12.32),
    "NiO": (-1.218, 6.76),
    "Ni-SiO2": (-2.080852, 3.2926),
    "Rh": (0.022, 12.38),
    "Ce": (0.075, 8.98),
    "Fe": (0.148, 7.59),
    "Pd": (0.015, 11.73),
    "Mg": (0.04, 1.81),
    "Y2O3": (-3.905, 5.03),
    "Ba": (0.175, 3.62),
    "K": (0.015, 0.83),
    "CeO2": (-3.755, 6.99),
    "Cu": (0.033, 9.2),
    "Ca": (0.18, 1.44),
    "Mn": (0.421, 8.74),
    "Zr": (0.057, 6.52),
    "Y": (0.098, 4.44),
    "La2O3": (3.733, 5.9),
    "VOx": (0.247, 6.2),
    "La": (0.019, 6.12),
    "Pr": (0.126, 6.34),
    "Eu": (0.041, 5.58),
    "Gd": (0.15, 7.75),
    "Na": (0.016, 1.02),
    "Cs": (0.019, 1.8),
    "Li": (0.002, 0.57),
    "Al2O3": (-3.352, 3.87),
    "Sr": (0.045, 2.61),
    "Yb": (0.014, 7.01),
    "Sm": (0.019, 7.27),
    "TiO2": (-3.316, 3.86),
    "SiO2": (-3.04, 2.63),
    "ZrO2": (-3.755, 6.04),
    "SBA-15": (-3.02, 1.97),
    "MgO": (-2.995, 3.63),
    "SiC": (-0.204, 3.23),
    "AC": (0.009, 0.9),
    "MSN": (0.61, 2.31),
    "MCM-41": (-3.04, 2.2),
    "Zeolite": (-3.081, 1.561428571),
    "NC": (0.008, 1.94),
    "Na-Zeolite": (-3.081, 2.31),
    "Cs-Zeolite": (-3.081, 1.95),
    "Fe2O3": (-1.588, 4.56),
    "OCF": (0.008, 1.94),
    "AX": (-2.349758, 2.053934627),
    "B": (0.02, 2.32),
    "PC": (-0.51, 3.367),
    "eg-C3N4": (0.322, 3.5),
    "Cr2O3": (-2.367, 5.17),
    "YMnO3": (-0.3008, 5.09),
    "Mn3O4": (-2.05, 4.89),
    "ZnO": (-1.635, 5.71),
    "Gd2O3": (-3.718, 8.48),
    "Sm2O3": (-3.753, 7.08),
    "Pr2O3": (-3.603, 6.9),
    "MgO-Nd2O3": (-8.83, 4.31),
    "Nd2O3": (-3.665, 6.49),
}

# --- fixed values: preparation method -> (scalability, cost) ----------------
METHODS = {
    "MC": (4, 2),
    "WI": (5, 1),
    "FM": (5, 1),
    "IWI": (5, 1),
    "CP": (4, 3),
    "SGP": (4, 3),
    "AE": (3, 2),
    "SCT": (4, 2),
    "IWI-DBD": (3, 5),
    "DPA": (3, 3),
    "DPU": (4, 3),
    "Commercial": (5, 1),
    "FSP": (3, 5),
    "DBD": (3, 5),
    "CI": (4, 3),
    "EISA": (2, 5),
    "OUCI": (3, 3),
    "DP": (3, 3),
    "CC": (4, 3),
    "ME": (5, 1),
    "CP-MSM": (3, 3),
    "UH": (3, 3),
    "H": (4, 3),
    "OH": (3, 3),
    "MI": (4, 3),
}

# --- fixed values: text that stands for "missing" ----------------------------
MISSING_TOKENS = ("?", "NA", "nan")
MISSING_TOKENS_EXTENDED = ("?", "NA", "nan", "NaN")
# what a spreadsheet or CSV reader already treats as missing
READER_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: the roles a material can play in a catalyst ---------------
ROLES = ("Active component", "Promoter", "Support a", "Support b")

# --- fixed values: unified schema, in order, with its types ------------------
UNIFIED_SCHEMA = [
    ("Number of data", "string"),
    ("Reference", "string"),
    ("Experiment No", "string"),
    ("Train/Test Set", "string"),
    ("Active component type", "string"),
    ("Active component type density", "double"),
    ("Active component type formation energy", "double"),
    ("Active component content (wt%)", "double"),
    ("Promoter type", "string"),
    ("Promoter type density", "double"),
    ("Promoter type formation energy", "double"),
    ("Promoter content (wt%)", "double"),
    ("Support a type", "string"),
    ("Support a type density", "double"),
    ("Support a type formation energy", "double"),
    ("Support a content (wt%)", "double"),
    ("Support b type", "string"),
    ("Support b type density", "double"),
    ("Support b type formation energy", "double"),
    ("Support b content (wt%)", "double"),
    ("Preparation method", "string"),
    ("Preparation Scalability", "int"),
    ("Preparation cost", "int"),
    ("Calcination Temperature (C)", "double"),
    ("Calcination time (h)", "double"),
    ("Reduction Temperature (C)", "double"),
    ("Reduction Pressure (bar)", "double"),
    ("Reduction time (h)", "double"),
    ("Reduced hydrogen content (vol%)", "double"),
    ("Temperature (C)", "double"),
    ("Pressure (bar)", "double"),
    ("Weight hourly space velocity [mgcat/(min·ml)]", "double"),
    ("Time on Stream (h)", "double"),
    ("Content of inert components in raw materials (vol%)", "double"),
    ("CO % in feed", "double"),
    ("CH4 % in feed", "double"),
    ("H2O % in feed", "double"),
    ("H2/CO2 ratio (mol/mol)", "double"),
    ("CO2 conversion ratio(%)", "double"),
    ("CH4 selectivity (%)", "double"),
    ("CH4 yield(%)", "double"),
]
TARGETS = ("CO2 conversion ratio(%)", "CH4 selectivity (%)", "CH4 yield(%)")

# --- fixed values: headers of the coded sheet that differ from the schema ----
CODED_SHEET_NAMES = {
    "Support\na type": "Support a type",
    "Support\na type density": "Support a type density",
    "Support\na type formation energy": "Support a type formation energy",
    "Support a\ncontent (wt%)": "Support a content (wt%)",
    "Support\nb type": "Support b type",
    "Support\nb type density": "Support b type density",
    "Support\nb type formation energy": "Support b type formation energy",
    "Calcination Temperature (℃)": "Calcination Temperature (C)",
    "Reduction Temperature (℃)": "Reduction Temperature (C)",
    "Reduction time  (h)": "Reduction time (h)",
    "Temperature (℃)": "Temperature (C)",
    "H2/CO2\nratio (mol/mol)": "H2/CO2 ratio (mol/mol)",
    "CO2\nconversion ratio(%)": "CO2 conversion ratio(%)",
    "CH4\nselectivity (%)": "CH4 selectivity (%)",
    "CH4\nyield(%)": "CH4 yield(%)",
}

# --- fixed values: headers of the second laboratory's sheet ------------------
LAB_SHEET_NAMES = {
    "Base": "Active component type",
    "Base wt%": "Active component content (wt%)",
    "Base 2": "Promoter type",
    "Base 2 wt%": "Promoter content (wt%)",
    "Support": "Support a type",
    "Support wt%": "Support a content (wt%)",
    "Support 2": "Support b type",
    "Catalyst preparation method": "Preparation method",
    "Reduction time  (h)": "Reduction time (h)",
    "Reduction  H2 %": "Reduced hydrogen content (vol%)",
    "W/F (mgcat/minml)": "Weight hourly space velocity [mgcat/(min·ml)]",
    "Inert % in feed": "Content of inert components in raw materials (vol%)",
    "H2/CO2 in feed": "H2/CO2 ratio (mol/mol)",
    "CO2 Conversion %": "CO2 conversion ratio(%)",
}

# --- fixed values: model feature -> short code -------------------------------
FEATURE_CODES = {
    "Active component formation energy": "ACFE",
    "Active component density": "ACD",
    "Active component content (wt percent)": "ACW",
    "Promoter formation energy": "PFE",
    "Promoter density": "PD",
    "Promoter content (wt percent)": "PW",
    "Support a formation energy": "SAFE",
    "Support a density": "SAD",
    "Support a content (wt percent)": "SAW",
    "Support b formation energy": "SBFE",
    "Support b density": "SBD",
    "Calcination Temperature (C)": "CTC",
    "Calcination time (h)": "CTH",
    "Reduction Temperature (C)": "RTC",
    "Reduction Pressure (bar)": "RPB",
    "Reduction time (h)": "RTH",
    "Reduced hydrogen content (vol percent)": "RHC",
    "Temperature (C)": "T",
    "Pressure (bar)": "P",
    "Weight hourly space velocity [mgcat/(min·ml)]": "WHSV",
    "Content of inert components in raw materials (vol percent)": "CIRMW",
    "h2/co2 ratio (mol/mol)": "H2_CO2",
    "Preparation Scalability": "PS",
    "Preparation cost": "PC",
}

# --- fixed values: row windows of the result sheets (header row, last row) ---
# (x ordinal, first row, last row); windows are 1-based and tile the sheet
FLOW_WINDOWS = [
    (3, 2, 17), (3, 19, 34), (3, 36, 51), (3, 53, 68),
    (4, 70, 88),
    (0, 90, 109), (0, 111, 130), (0, 132, 151), (0, 153, 172),
    (2, 174, 189), (2, 191, 206), (2, 208, 223), (2, 225, 240),
]
YIELD_WINDOWS = [(2, 2 + 20 * i, 20 + 20 * i) for i in range(9)]
EXERGY_WINDOWS = [(2, 2 + 20 * i, 20 + 20 * i) for i in range(6)]
SPECIES = ("CH4", "H2O", "N2", "CO2", "CO", "H2", "C")
FLOW_ORDINALS = (6, 7, 8, 9, 10, 11, 12)
WEIGHT_ORDINALS = (13, 14, 15, 16, 17, 18, 19)
YIELD_ORDINALS = (15, 16, 17, 18)
EXERGY_ORDINALS = (9, 10, 14, 15)
# reaction blocks: quantity -> ordinal in the first block; blocks repeat with the stride
REACTION_BLOCKS = {"dH": 1, "dS": 2, "dG": 3, "logK": 6}
REACTION_STRIDE = 8
REACTION_COUNT = 6

# --- fixed values: designs, factor -> (low, high, step) ----------------------
QUASI_DESIGN = {"T": (50, 500, 50), "P": (1, 30, 1), "f_co2_co": (0.5, 2.0, 0.25), "f_h2": (0.5, 2.0, 0.5)}
FACTORIAL_DESIGN = {"T": (50, 500, 25), "P": (1, 30, 1), "f_co2_co": (0.25, 2.0, 0.25), "f_h2": (0.25, 2.0, 0.25)}
PROCESS_INPUTS = ("Reactor Temp", "Pressure", "Off-Gas Flow", "H2 Inlet Flow")

# --- fixed values: Joe & Kuo (2008) direction numbers, "new-joe-kuo-6" -------
# (degree s, coefficient a, initial numbers m); dimension 1 is the van der Corput sequence
DIRECTION_NUMBERS = [
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
    (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)),
]

# --- fixed values: Wichura (1988), algorithm AS 241, highest power first -----
NORMAL_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NORMAL_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
NORMAL_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)

# --- fixed values: search spaces ---------------------------------------------
FOREST_CHOICES = {
    "n_trees": [100, 300, 500],
    "max_depth": [10, 20, 30, None],
    "min_split": [2, 5, 10],
    "min_leaf": [1, 2, 4],
}
BOOST_CHOICES = {
    "n_trees": [100, 300, 500],
    "max_depth": [3, 6, 10],
    "learning_rate": [0.01, 0.05, 0.1],
    "row_fraction": [0.8, 1.0],
    "column_fraction": [0.8, 1.0],
}
SEARCH_RANGES = {
    "RF": {"n_trees": (100, 1000), "max_depth": (3, 50), "min_split": (2, 20), "min_leaf": (1, 10)},
    "BR": {"n_trees": (50, 500), "row_fraction": (0.1, 1.0), "column_fraction": (0.1, 1.0)},
    "GBDT": {"n_trees": (50, 500), "learning_rate": (0.001, 0.2, "log"), "max_depth": (3, 10), "min_split": (2, 20)},
    "LGBM": {"n_trees": (50, 500), "learning_rate": (0.001, 0.2, "log"), "num_leaves": (20, 150), "max_depth": (3, 12)},
    "XGB": {"n_trees": (50, 500), "learning_rate": (0.001, 0.2, "log"), "max_depth": (3, 12), "row_fraction": (0.5, 1.0)},
    "CB": {"n_trees": (50, 500), "learning_rate": (0.001, 0.2, "log"), "max_depth": (3, 10), "l2": (1, 10)},
}
