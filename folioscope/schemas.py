"""The label dimension and the article record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels in order: name, code (None: no code of its own), group. Fixed values.
LABELS = (
    ("_3D_ThreeDee", "3D", "OTHER"),
    ("AN_Angiography", "AN", "RADIOLOGY"),
    ("CM_CompoundFigure", "CM", "OTHER"),
    ("CT_ComputedTomography", "CT", "RADIOLOGY"),
    ("DM_Dermatology", "DM", "PHOTOGRAPH"),
    ("DR_Drawing", "DR", "GRAPHIC"),
    ("EM_ElectronMicroscopy", "EM", "MICROSCOPY"),
    ("EN_Endoscope", "EN", "PHOTOGRAPH"),
    ("FL_Fluorescense", "FL", "MICROSCOPY"),
    ("GL_Gel", "GL", "MICROSCOPY"),
    ("GX_Graphs", "GX", "GRAPHIC"),
    ("GR_GrossPathology", "GR", "PHOTOGRAPH"),
    ("HX_Histopathology", "HX", "MICROSCOPY"),
    ("MR_MagneticResonance", "MR", "RADIOLOGY"),
    ("PX_Photo", "PX", "PHOTOGRAPH"),
    ("RN_Retinograph", "RN", "PHOTOGRAPH"),
    ("US_Ultrasound", "US", "RADIOLOGY"),
    ("XR_XRay", "XR", "RADIOLOGY"),
    ("UnspecifiedRadiology", None, "RADIOLOGY"),
    ("UnspecifiedGraphic", None, "GRAPHIC"),
    ("UnspecifiedMicroscopy", None, "MICROSCOPY"),
    ("UnspecifiedPhotograph", None, "PHOTOGRAPH"),
)
GROUPS = ("RADIOLOGY", "MICROSCOPY", "PHOTOGRAPH", "GRAPHIC", "OTHER")
DEFAULT_LABEL, NONE = "PX", "NONE"

#: A label is keyed by its code, or by its name where it has none, so no two share a key.
LABEL_KEYS = tuple(code or name for name, code, _ in LABELS)

GRAPHIC = T.StructType([T.StructField("id", T.StringType()), T.StructField("predictions", T.MapType(T.StringType(), T.FloatType()))])
FIGURE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("caption", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())), T.StructField("graphics", T.ArrayType(GRAPHIC)),
])
ARTICLE = T.StructType([
    *(T.StructField(n, T.IntegerType()) for n in ("pmcid", "pmid")),
    *(T.StructField(n, T.StringType()) for n in ("publisher", "journal", "doi", "id", "dir", "title", "subject")),
    T.StructField("figures", T.ArrayType(FIGURE)),
])


def label_dimension(spark: SparkSession) -> DataFrame:
    """(ordinal, label, name, code, grp): 22 rows of literals."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(code or name).alias("label"), F.lit(name).alias("name"), F.lit(code).alias("code"), F.lit(group).alias("grp"))
        for i, (name, code, group) in enumerate(LABELS)
    ])
    return spark.range(1).select(F.inline(rows))
