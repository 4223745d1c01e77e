"""Tag classes, role classes and punctuation codes of the treebank format."""

# Tag -> coarse class; other tags are upper-cased.
COARSE = {
    "ncn": "N", "nct": "N", "npn": "N", "ntit": "N", "pper": "N", "pdem": "N", "pind": "N", "pint": "N",
    "vi": "V", "vt": "V", "vcau": "V", "vcs": "V", "vex": "V", "honm": "V",
    "det": "DET", "indet": "DET", "adv": "ADV", "conj": "CONJ", "conjc": "CONJ", "conjncl": "CONJ",
    "prep": "PREP", "prepc": "PREP", "pref1": "PREFIX", "pref2": "PREFIX", "pref3": "PREFIX",
    "aff": "PART", "part": "PART", "neg": "NEG", "negc": "NEG",
    "advm1": "ADVM", "advm2": "ADVM", "advm3": "ADVM", "advm4": "ADVM", "advm5": "ADVM",
    "ppos": "MP", "prfx": "MP", "prec": "MP",
}
# All tags.
TAGS = sorted([*COARSE, "adj", "blk", "cl", "idm", "int", "nlab", "nnum", "norm", "prel", "prev", "psm", "punc", "sym", "vpost"])
# Roles.
COMPLEMENTS = ["root", "subj", "csubj", "dobj", "iobj", "pcomp", "pobj", "pred", "cpred", "sconj", "conj", "nom", "advm"]
ADJUNCTS = ["modp", "modr", "appa", "appr", "rel", "modt", "modm", "modl", "moda", "dprep", "det", "quan", "cl", "coord", "neg", "punc", "svp", "svs"]
CONTENT = ["ncn", "nct", "npn", "ntit", "vi", "vt", "vcau", "vcs", "vex", "honm", "adj", "adv"]
PREFIXES = ["pref1", "pref2", "pref3"]
PUNCTUATION = {",": "-COMMA-", "(": "-LRB-", ")": "-RRB-"}
# Tags for which generic rules are not looked up: nouns, numbers, labels, pronouns and conjunctions.
NO_GENERIC_RULES = ["ncn", "nct", "npn", "ntit", "nnum", "nlab", "pper", "pdem", "pind", "pint", "conj", "conjc", "conjncl"]
