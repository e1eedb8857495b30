"""Lexicons and patterns. They are parameters of the functions; these are the defaults."""

# Word lists, patterns and the unit map that results must agree with.
ACTIONS = ["incubate", "centrifuge", "mix", "add", "transfer", "pipette", "aliquot", "vortex", "resuspend", "pellet", "wash", "dry", "filter", "measure", "dilute", "prepare", "heat", "cool", "shake", "spin", "stain", "fix", "mount", "label", "load", "elute"]
MATERIALS = ["buffer", "pbs", "ethanol", "methanol", "bleach", "nacl", "glycerol", "yeast", "agar", "water", "h2o", "dmso", "triton", "edta", "mgso4", "kcl", "k2hpo4", "kh2po4", "nh4", "medium", "media", "reagent", "solution"]
PARAM = r"\b(\d+(?:\.\d+)?)\s*(°c|degc|s|min|h|hr|hrs|ms|rpm|g|xg|µl|ul|ml|l|%)\b"
UNITS = {"ul": "µl", "μl": "µl", "µl": "µl", "ml": "ml", "l": "l", "degc": "°c", "°c": "°c", "°f": "°f", "hr": "h", "hour": "h", "hours": "h", "sec": "s", "ms": "ms", "s": "s", "min": "min", "h": "h", "um": "µm", "µm": "µm", "mm": "mm", "cm": "cm", "nm": "nm", "mmol": "mM", "millimolar": "mM", "mg/ml": "mg/ml", "g/l": "g/l", "%": "%", "rpm": "rpm"}
SCALED_PARAM = r"(\d+(?:\.\d+)?)(?:\s*(?:×|x)\s*10\^?([-+]?\d+))?\s*(°c|degc|°f|min|h|hr|hours?|s|sec|m?s|µl|ul|ml|l|mg|g|kg|ng|pg|mm|cm|µm|um|nm|mM|µM|uM|nM|%|rpm|g\/l|mg\/ml|m\/v|v\/v)"
LOOSE_PARAM = r"\d+(?:\.\d+)?\s*(?:°c|degc|°f|min|h|hr|s|sec|ms|µl|ul|ml|l|mg|g|kg|ng|pg|mm|cm|µm|um|nm|mM|µM|uM|nM|%|rpm|g/l|mg/ml)"
STEP_ACTIONS = ["add", "mix", "incubate", "centrifuge", "wash", "filter", "resuspend", "dissolve", "measure", "read", "inject", "prepare", "stain", "vortex", "sonicate", "pipette", "aliquot", "store", "dry", "heat", "cool", "spin", "pellet", "separate", "equilibrate", "calibrate", "label", "rinse", "mount", "transfer", "load", "elute", "dilute", "prewarm", "precool", "thaw", "freeze", "count", "seed", "harvest"]
HEADERS = ["meta", "materials", "solutions", "equipment", "steps", "dependencies", "outputs"]
VERBS = ["add", "mix", "vortex", "incubate", "centrifuge", "wash", "rinse", "filter", "prepare", "resuspend", "dissolve", "measure", "read", "quantify", "inject", "mount", "stain", "dry", "equilibrate", "prewarm", "thaw", "shake", "stir"]
PREPARING = ["sterilize", "prepare", "dissolve", "mix", "resuspend", "equilibrate", "prewarm", "thaw", "buffer", "solution"]
ANALYSING = ["measure", "read", "quantify", "analyze", "inject", "calculate"]
TIMED = ["incubate", "centrifuge", "mix", "resuspend", "stir", "shake"]
# verbs whose heading isn't the verb with a capital
HEADINGS = {"prewarm": "Pre-warm", "step": "Do"}
VALUE_UNIT = r"(\d+(?:\.\d+)?)\s*((?:mM|M|μ?g/?mL|mg/?mL|μ?L|mL|%|rpm|×\s?g|g))"
TIME = r"\d+(?:\.\d+)?\s*(?:s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hour|hours)"
TEMPERATURE = r"-?\d+(?:\.\d+)?\s*°?\s*C"
RPM = r"(\d{2,5})\s*rpm"
GRAVITY = r"(\d+(?:\.\d+)?)\s*×\s*g"
PLAN_TITLES = ["Preparation & Materials", "Procedure", "Analysis / Readout"]
SECTION_KEYS = ["title", "abstract_text", "intro_text", "methods_text", "results_text", "discussion_text", "conclusion_text", "ack_text"]
BLOCKED = "publisher does not allow downloading of the full text in xml form"
# common English words that no query needs; a parameter of the functions that drop them
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with"]
