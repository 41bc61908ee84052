"""Input schemas. Nothing is inferred: every reader casts to one of these."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# Income components of a tax unit, as named in the input file.
INCOME_ADDED = (
    "wages", "txbl_int", "div_ord", "div_pref", "txbl_ira_dist", "txbl_pens_dist", "sole_prop",
    "kg_lt", "kg_st", "part_active", "part_passive", "scorp_active", "scorp_passive", "rent",
    "estate", "farm", "ui", "gross_ss", "other_inc",
)
INCOME_SUBTRACTED = (
    "part_active_loss", "part_passive_loss", "part_179", "scorp_active_loss", "scorp_passive_loss",
    "scorp_179", "rent_loss", "estate_loss",
)

# Detail-file columns of the three reported transfers (type, value, year).
TRANSFER_COLUMNS = {
    1: ("x5803", "x5804", "x5805"),
    2: ("x5808", "x5809", "x5810"),
    3: ("x5813", "x5814", "x5815"),
}

NET_WORTH = T.StructType(
    [T.StructField("date", _STRING), T.StructField("FL152090005.Q", _STRING)]
)

SURVEY_SUMMARY = _schema(
    YY1=_LONG, Y1=_LONG, WGT=_DOUBLE, AGE=_INT, MARRIED=_INT, KIDS=_INT, INCOME=_DOUBLE
)

SURVEY_DETAIL = T.StructType(
    [T.StructField("yy1", _LONG), T.StructField("y1", _LONG)]
    + [
        T.StructField(name, kind)
        for names in TRANSFER_COLUMNS.values()
        for name, kind in zip(names, (_INT, _DOUBLE, _INT))
    ]
)

TAX_UNITS = T.StructType(
    [
        T.StructField("id", _LONG),
        T.StructField("weight", _DOUBLE),
        T.StructField("age1", _INT),
        T.StructField("filing_status", _INT),
        T.StructField("dep_age1", _INT),
        T.StructField("dep_age2", _INT),
        T.StructField("dep_age3", _INT),
    ]
    + [T.StructField(name, _DOUBLE) for name in INCOME_ADDED + INCOME_SUBTRACTED]
)

ESTATE_TAX_DETAIL = _schema(
    id=_LONG, p_inheritance=_DOUBLE, inheritance=_DOUBLE, estate_tax_liability=_DOUBLE
)
