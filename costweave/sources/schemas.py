"""Declared schemas of the input shapes."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind, names):
    return [T.StructField(n, kind) for n in names]


_text, _real, _whole = T.StringType(), T.DoubleType(), T.IntegerType()

# Stage heat map: entity columns, hourly measurements t0..t8, three later ones.
STAGE_MATRIX = T.StructType(
    _fields(_text, ["Class", "regulators", "gene", "locus_tag"])
    + _fields(_real, [f"t{i}" for i in range(9)] + ["g135", "g150", "g180"])
)
STAGE_LABELS = {
    "vegetative": "1.vegetative",
    "starvation": "2.starvation",
    "onset": "3.onset",
    "commitment": "4.commitment",
    "engulfment": "5.engulfment",
}

# Presence course: 0/1 every half hour.
PRESENCE_COURSE = T.StructType(_fields(_text, ["gene"]) + _fields(_whole, ["t30", "t60", "t90", "t120", "t150"]))

# Cumulative scores at growing minutes.
SCORE_COURSE = T.StructType(
    _fields(_text, ["ProtID"]) + _fields(_whole, ["T0", "T15", "T30", "T60", "T90", "T150", "T210", "T330"])
)

# -1 / 0 / 1 calls between consecutive samplings.
CALL_COURSE = T.StructType(
    _fields(_text, ["protID", "gene"])
    + _fields(
        _whole,
        ["Tminus30_T0", "T0_T15", "T15_T30", "T30_T45", "T45_T60", "T60_T90", "T90_T150", "T150_T210", "T210_T330"],
    )
)

MUTANT_SCORES = T.StructType(
    _fields(_text, ["locus_tag", "gene"]) + _fields(_real, ["rSS_average"]) + _fields(_text, ["mutant"])
)
RESIDUE_PRICE_TABLE = T.StructType(
    _fields(_text, ["amino_acid", "symbol"]) + _fields(_whole, ["opportunity_costs", "direct_costs"])
)
NUCLEOTIDE_PRICE_TABLE = T.StructType(
    _fields(_text, ["molecule", "nucleotides", "symbol"]) + _fields(_real, ["opportunity", "direct"])
)
EFFICIENCY = T.StructType(_fields(_real, ["efficiency"]))
TRAITS = T.StructType(_fields(_text, ["gene", "category"]))
SYNONYMS = T.StructType(
    _fields(_text, ["locus_tag", "name", "alias"]) + _fields(_real, ["abundance"]) + _fields(_text, ["note"])
)
SEQUENCES = T.StructType(_fields(_text, ["protID", "gene", "sequence"]))

# Interval labels: label, hours it lasts, ordinal bucket. Fixed values.
GENE_CALL_INTERVALS = (
    ("Tminus30_Tminus15", 0.25, "H00"),
    ("Tminus15_T0", 0.25, "H00"),
    ("T0_T15", 0.25, "H0.25"),
    ("T15_T30", 0.25, "H0.5"),
    ("T30_T60", 0.5, "H1"),
    ("T60_T150", 1.5, "H2.5"),
    ("T150_T330", 1.0, "H5.5"),
)
PROTEIN_CALL_INTERVALS = (
    ("Tminus30_T0", 0.5, "H00"),
    ("T0_T15", 0.25, "H0.25"),
    ("T15_T30", 0.25, "H0.5"),
    ("T30_T45", 0.25, "H0.75"),
    ("T45_T60", 0.25, "H1"),
    ("T60_T90", 0.5, "H1.5"),
    ("T90_T150", 1.0, "H2.5"),
    ("T150_T210", 1.0, "H3.5"),
    ("T210_T330", 2.0, "H5.5"),
)
SCORE_INTERVALS = (
    ("H0.25", 0.25),
    ("H0.5", 0.25),
    ("H1", 0.5),
    ("H1.5", 0.5),
    ("H2", 0.5),
    ("H3", 1.0),
    ("H4", 1.0),
    ("H5.5", 1.5),
)
