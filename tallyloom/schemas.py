"""Schemas of the inputs and of the tables between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _LONG, _INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


EXAMPLES = ("positive_example_1", "positive_example_2", "negative_example_1", "negative_example_2")
# The score columns of the two toxicity sets.
DATA2_SCORES = ("severe_toxicity", "obscene", "threat", "insult", "identity_hate")
DATA3_SCORES = ("severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit")

TEST = _table(("row_id", _LONG), ("body", _STRING), ("rule", _STRING), ("subreddit", _STRING), *((c, _STRING) for c in EXAMPLES))
TRAIN = T.StructType([*TEST.fields, T.StructField("rule_violation", _INT)])
DATA2 = _table(("comment_text", _STRING), *((c, _DOUBLE) for c in DATA2_SCORES))
DATA3 = _table(("comment_text", _STRING), *((c, _DOUBLE) for c in DATA3_SCORES))
RULE_DEF = _table(("rule_key", _STRING), ("rule", _STRING))
RULE_VARIANT = _table(("rule", _STRING), ("variant_no", _INT), ("text", _STRING))
POOL = _table(("pool_id", _STRING), ("pos", _LONG), ("text", _STRING))
POOL_REF = _table(("split", _STRING), ("rule", _STRING), ("polarity", _STRING), ("pool_id", _STRING))
POOL_TOKENS = _table(("pool_id", _STRING), ("pos", _LONG), ("ids", T.ArrayType(_INT)))
VOCAB_MAP = _table(("old_id", _INT), ("new_id", _LONG))
LOGITS = _table(("row_id", _LONG), ("variant", _INT), ("logit_no", _DOUBLE), ("logit_yes", _DOUBLE))
SUBMISSION = _table(("row_id", _LONG), ("rule_violation", _DOUBLE))
HEAD = _table(("class_id", _INT), ("w", T.ArrayType(T.FloatType())))
