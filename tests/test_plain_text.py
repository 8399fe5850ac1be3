"""Text that skips normalization must be its own normal form."""

import re
import unicodedata

from tidewatch.functions.text import _PLAIN
from tidewatch.plans.registry import QUERIES


def test_plain_characters_are_normal_and_do_not_combine():
    characters = [chr(c) for c in range(0x10000)
                  if not 0xD800 <= c < 0xE000 and re.fullmatch(_PLAIN, chr(c))]
    assert len(characters) > 20_000
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
               for c in characters)
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    assert not seconds & set(characters)


def test_texts_are_cleaned_once(spark):
    plan = QUERIES["cleaned_features"](spark, "/root/testdata/sf0.001") \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
