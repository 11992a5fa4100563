"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """From ``name kind, name kind``, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in spec.split(", "))])


ENTITY = _struct("code string, name string")
PARENT = _struct("l3 string, name string")
LEVEL4 = _struct("l4 string, name string")
PROCEDURE = _struct("code string, name string")
ALIAS = _struct("a string, b string")
ALIAS_CANON = _struct("name string, canon string")
KEYWORD = _struct("code string, token string, weight double")
ENTITY_TOKENS = _struct("code string, tokens array<string>, name string")
LABEL = _struct("code string, mention string, entity string")
ITEM = _struct("record_id long, slot int, role string, name string")
EDGE = _struct("src string, dst string, weight double")
WIDE_RECORD = _struct(", ".join([*(f"d{k} string" for k in range(1, 12)), *(f"p{k} string" for k in range(1, 11))]))
WIDE_RECORD_ID = T.StructType([T.StructField("id", T.StringType()), *WIDE_RECORD.fields])
CASE = T.StructType([T.StructField("mention", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("main", T.ArrayType(T.StringType())), T.StructField("other", T.ArrayType(T.StringType()))])
