"""Schemas and vocabularies of extraction: patterns, units, noise, categories, names and ranges."""

from __future__ import annotations

from pyspark.sql import types as T

#: One extracted or collected value of one variable of one paper.
OBSERVATION = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("paper", "sentence", "entity", "entity_label", "value_raw")],
        T.StructField("value", T.DoubleType()),
        *[T.StructField(n, T.StringType()) for n in ("unit", "relation_method", "category", "normalized_variable")],
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

# Fixed values from here on: they decide results and are kept in their usual order.

_NUM = r"(\d+\.?\d*)"

#: (variable, pattern, unit or None for the unit in the second group), of falling priority.
TEXT_PATTERNS = (
    ("d90_µm", rf"d90\s*=?\s*{_NUM}\s*(µm|nm|mm)", None),
    ("d50_µm", rf"d[v,]?0[.,]5\s*=?\s*{_NUM}\s*(µm|nm|mm)", None),
    ("d32_µm", rf"d3[,.]2\s*=?\s*{_NUM}\s*(µm|nm|mm)", None),
    ("d43_µm", rf"d4[,.]3\s*=?\s*{_NUM}\s*(µm|nm|mm)", None),
    ("Temperature_C", rf"{_NUM}\s*°C", "°C"),
    ("Concentration_wt%", rf"{_NUM}\s*wt\.?%", "wt%"),
    ("Homogenization_rpm", r"(\d[\d,]*)\s*rpm", "rpm"),
    ("Processing_time_s", r"for\s+(\d+)\s*s\b", "s"),
    ("Participants_n", r"(\d+)\s*(?:pre.trained\s+)?(?:panelists?|participants?|assessors?)", ""),
    ("Viscosity_Pa_s", rf"{_NUM}\s*Pa[·.]s", "Pa·s"),
    ("Sliding_speed_mm_s", rf"{_NUM}\s*mm/s", "mm/s"),
    ("Normal_force_N", rf"{_NUM}\s*N\b", "N"),
    ("Pressure_bar", r"(\d+)\s*bar\b", "bar"),
    ("Pressure_MPa", rf"{_NUM}\s*MPa\b", "MPa"),
    ("Volume_mL", rf"{_NUM}\s*mL\b", "mL"),
    ("Shear_rate_s-1", rf"{_NUM}\s*s[\-⁻]1", "s⁻¹"),
    ("Particle_size_µm", rf"{_NUM}\s*(µm|nm|mm)\b", None),
)
#: The library for text read off images: no 'pre-trained' and a percentage of fat at the end; given as the difference, since the rest is the same list.
IMAGE_PATTERNS = (
    *[(v, p.replace(r"(?:pre.trained\s+)?", ""), u) for v, p, u in TEXT_PATTERNS],
    ("Fat_concentration_wt%", rf"{_NUM}\s*%\s*(?:fat|oil|lipid)", "wt%"),
)
#: Patterns of a paper's features for prediction.
FEATURE_PATTERNS = (
    ("Temperature_C", rf"{_NUM}\s*°C"),
    ("Homogenization_rpm", r"(\d[\d,]*)\s*rpm"),
    ("Pressure_MPa", rf"{_NUM}\s*MPa"),
    ("Fat_concentration_wt%", rf"{_NUM}\s*wt\.?%"),
    ("Concentration_wt%", rf"{_NUM}\s*%\b"),
    ("Volume_mL", rf"{_NUM}\s*mL"),
)
PROTEIN_WORDS = ("whey protein", "whey", "casein", "sodium caseinate", "soy protein", "pea protein", "milk protein", "β-lactoglobulin", "lactalbumin", "ovalbumin", "gelatin", "protein")
OIL_WORDS = ("sunflower oil", "rapeseed oil", "canola oil", "olive oil", "soybean oil", "corn oil", "fish oil", "palm oil", "MCT oil", "triglyceride", "oil", "fat", "lipid")
OIL_TYPES = ("olive oil", "sunflower oil", "palm oil", "coconut oil", "soybean oil", "corn oil", "canola oil", "rapeseed oil")

#: Where the body of a paper begins and ends.
BODY_START = r"\bAbstract\b"
BODY_END = r"\n\s*(References|Bibliography|Acknowledgments?|Funding|Author\s+Contributions?|Conflicts?\s+of\s+Interest|Supplementary|Appendix)\b"

UNITS = (
    "µm", "um", "nm", "mm", "cm", "m", "%", "wt%", "wt.%", "w/w", "v/v", "w/v", "g/l", "mg/l", "mg/ml", "g/ml", "µg/ml", "µg/g", "g", "kg", "mg", "µg", "ml", "µl", "l",
    "°c", "°f", "k", "kj", "kcal", "mpa", "pa", "kpa", "pa·s", "pa.s", "mpa·s", "cp", "rpm", "min", "h", "s", "mol", "mmol", "µmol", "mm/s", "n", "bar",
)
NOISE = (
    "results", "result", "study", "studies", "effect", "effects", "systems", "system", "increase", "increases", "decrease", "decreases", "reduction", "reductions", "figure", "table", "foods", "food",
    "constant", "distribution", "method", "methods", "analysis", "data", "group", "groups", "model", "models", "value", "values", "level", "levels", "condition", "conditions", "factor", "factors",
    "parameter", "parameters", "sample", "samples", "surfaces", "surface", "perceived", "perception", "significant", "difference", "differences", "term", "terms", "type", "types", "mean", "range", "rate",
    "composition", "hereinafter", "herein", "respectively", "whereas", "however", "therefore", "moreover", "furthermore", "addition",
)
MORE_NOISE = (
    "soft texture", "oil phase", "intensity scoring", "rheological", "rheological properties", "tribological", "tribological properties", "emulsion film", "lubricating film", "boundary regime",
    "mixed regime", "oral processing", "sensory properties", "sensory analysis", "mass fraction", "volume fraction", "friction curves", "flow curves", "shear rate", "sliding speed", "lubrication behavior",
)
#: Category -> words, any of which an entity contains; the first category counts.
CATEGORIES = {
    "Oil / Fat": ("oil", "fat", "lipid", "triglyceride", "olive", "sunflower", "rapeseed", "fatty"),
    "Protein": ("protein", "casein", "whey", "albumin", "gelatin", "gluten", "isolate", "concentrate"),
    "Emulsifier": ("emulsifier", "lecithin", "tween", "span", "surfactant", "saponin", "polysorbate"),
    "Droplet / Particle": ("droplet", "d90", "d50", "d32", "d43", "d10", "particle"),
    "Size / Diameter": ("size", "diameter"),
    "Emulsion": ("emulsion",),
    "Dairy": ("milk", "cream", "reconstituted", "skimmed", "lactose"),
    "Viscosity": ("viscosity", "rheol", "consistency", "flow"),
    "Friction / Lubrication": ("friction", "lubrication", "lubricating", "tribology", "coefficient"),
    "Sensory": ("panelist", "participant", "creaminess", "smoothness", "thickness", "mouthfeel", "texture", "sensory", "consumer", "perception"),
    "Composition": ("content", "concentration", "ratio", "proportion"),
    "Temperature": ("temperature", "temp"),
    "pH": ("ph",),
    "Processing": ("homogeniz", "sonication", "pressure", "speed", "rpm", "microfluidiz"),
}
#: Entity text -> variable.
TEXT_NAMES = {
    "olive oil": "Oil_type", "oil": "Oil_type", "fat": "Oil_Fat_type", "fat content": "Fat_concentration_wt%", "oil content": "Oil_concentration_wt%", "fat droplets": "Particle_type",
    "fat droplet": "Particle_type", "oil droplets": "Particle_type", "casein sodium salt": "Protein_type", "casein": "Protein_type", "whey protein": "Protein_type", "protein": "Protein_type",
    "protein concentration": "Protein_concentration_wt%", "milk": "Emulsion_system", "skimmed milk": "Emulsion_system", "milk cream": "Emulsion_system", "reconstituted milk": "Emulsion_system",
    "emulsion": "Emulsion_system", "emulsions": "Emulsion_system", "model emulsions": "Emulsion_system", "droplet size": "d90_µm", "droplet": "Particle_size_µm", "d90": "d90_µm",
    "size": "Particle_size_µm", "viscosity": "Viscosity_Pa_s", "apparent viscosity": "Viscosity_Pa_s", "friction": "Friction_coefficient", "friction curves": "Friction_coefficient",
    "friction coefficient": "Friction_coefficient", "lubrication": "Lubrication_property", "lubricating effect": "Lubrication_property", "panelists": "Participants_n", "participants": "Participants_n",
    "creaminess": "Sensory_creaminess", "smoothness": "Sensory_smoothness", "thickness": "Sensory_thickness", "temperature": "Temperature_C",
}
#: The names' version for text read off images, which has fewer of them and another one for oil; given as the difference, since the rest is the same list.
IMAGE_NAMES = {
    k: v
    for k, v in ({**TEXT_NAMES, "oil": "Oil_Fat_type"}).items()
    if k not in ("fat droplets", "fat droplet", "oil droplets", "casein sodium salt", "milk", "skimmed milk", "milk cream", "reconstituted milk", "emulsions", "model emulsions", "friction curves", "lubricating effect")
}
#: Variable -> least and greatest plausible value, both included.
RANGES = {
    "Sensory_creaminess": (0, 100), "Sensory_smoothness": (0, 100), "Sensory_thickness": (0, 100), "Participants_n": (1, 500), "Temperature_C": (0, 200), "Particle_size_µm": (0.001, 1000),
    "d90_µm": (0.001, 1000), "Viscosity_Pa_s": (0, 100000), "Friction_coefficient": (0, 5), "Lubrication_property": (0, 5), "Homogenization_rpm": (0, 50000), "Pressure_MPa": (0, 1000),
    "Pressure_bar": (0, 5000), "Fat_concentration_wt%": (0, 100), "Oil_concentration_wt%": (0, 100), "Protein_concentration_wt%": (0, 100), "Concentration_wt%": (0, 100), "Volume_mL": (0, 10000),
    "Processing_time_s": (0, 86400), "Shear_rate_s-1": (0, 100000), "Sliding_speed_mm_s": (0, 1000), "Normal_force_N": (0, 500),
}
#: Variables whose range is checked in text read off images.
IMAGE_RANGED = tuple(v for v in RANGES if v not in ("Lubrication_property", "Pressure_bar", "Processing_time_s", "Sliding_speed_mm_s", "Normal_force_N"))
SENSORY = ("Sensory_thickness", "Sensory_creaminess", "Sensory_smoothness")
INPUTS = (
    "Oil_type", "Fat_concentration_wt%", "Oil_concentration_wt%", "Protein_type", "Protein_concentration_wt%", "Concentration_wt%", "Emulsion_system", "Temperature_C", "Homogenization_rpm", "Pressure_MPa",
    "Pressure_bar", "Volume_mL", "Shear_rate_s-1", "Processing_time_s", "Participants_n",
)
OUTPUTS = (
    "Viscosity_Pa_s", "d90_µm", "d50_µm", "d43_µm", "d32_µm", "Particle_size_µm", "Sensory_thickness", "Sensory_creaminess", "Sensory_smoothness", "Friction_coefficient", "Lubrication_property",
    "Sliding_speed_mm_s", "Normal_force_N",
)
#: Unit of each variable of the wide dataset.
VARIABLE_UNITS = {
    "Fat_concentration_wt%": "wt%", "Oil_concentration_wt%": "wt%", "Protein_concentration_wt%": "wt%", "Concentration_wt%": "wt%", "Temperature_C": "°C", "Homogenization_rpm": "rpm", "Pressure_MPa": "MPa",
    "Pressure_bar": "bar", "Volume_mL": "mL", "Shear_rate_s-1": "s⁻¹", "Processing_time_s": "s", "Viscosity_Pa_s": "Pa·s", "d90_µm": "µm", "d50_µm": "µm", "d43_µm": "µm", "d32_µm": "µm",
    "Particle_size_µm": "µm", "Sensory_thickness": "/10", "Sensory_creaminess": "/10", "Sensory_smoothness": "/10", "Friction_coefficient": "—", "Sliding_speed_mm_s": "mm/s", "Normal_force_N": "N",
}
#: Variables of the evaluation: (variable, factor from the collected to the extracted unit, tolerance is relative).
EVALUATED = (("d90_µm", 1.0, True), ("Viscosity_Pa_s", 0.001, True), ("Sensory_thickness", 1.0, False), ("Sensory_creaminess", 1.0, False), ("Temperature_C", 1.0, True))
#: Features and targets of the regressions, with the papers a target needs.
FEATURES = ("Temperature_C", "Homogenization_rpm", "Pressure_MPa", "Fat_concentration_wt%", "Concentration_wt%", "Protein_type", "Oil_Fat_type", "Volume_mL")
TARGETS = {"Viscosity_Pa_s": 15, "d90_µm": 15, "Sensory_thickness": 5, "Sensory_creaminess": 5, "Friction_coefficient": 5}
#: Extraction method -> ordinal confidence, 1 is best.
CONFIDENCE = {"pattern": 1, "dependency": 2, "proximity": 3, "none": 4}
#: Replacements that turn a variable's name into a label, in this order.
LABEL_STEPS = (("_wt%", " (wt%)"), ("_rpm", " (rpm)"), ("_MPa", " (MPa)"), ("_mL", " (mL)"), ("_C", " (°C)"), ("_", " "))
#: Relative and absolute tolerance of the evaluation.
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 0.20, 1.0
