"""Valid JSON that the standard parser gives up on, and lists as text behind many blanks."""

import json
from datetime import datetime

import pytest

from riskloom.operators.records import child_links
from riskloom.operators.shred import _deep, parse

ASSET = '"assets": [{"id": "a", "misconfigurations": %s}]'
DEEP = "[" * 60_000 + "]" * 60_000


@pytest.mark.parametrize("text", ["1", ' {"a": [1, {"b": null}, []], "c": {}} ', '[[], {"x": "y\\n"}, -2.5e3, true]', '{"a": 1, "a": 2}', "[1,]", "[,1]", '{"a": 1,}', "{1: 2}", '{"a" 1}', "[1 2]", "[1]]", "[1", "", "[NaN]", '["a\nb"]', "[}", '{"a":}'])
def test_same_as_the_standard_parser(text):
    try:
        want = (json.loads(text, parse_constant=lambda w: (_ for _ in ()).throw(ValueError(w))),)
    except ValueError:
        with pytest.raises(ValueError):
            _deep(text)
    else:
        assert (_deep(text),) == want


def test_no_record_is_lost(spark):
    blanks = json.dumps(" " * 100 + '[{"id": "f"}]')
    texts = [(1, '{"extra": %s, %s}' % (DEEP, ASSET % '[{"id": "f"}]')), (2, '{"extra": %s, %s}' % ("7" * 5_000, ASSET % '[{"id": "f"}]')), (3, "{%s}" % (ASSET % blanks)), (4, DEEP[:-1])]
    assert parse(texts[0][1]) is not None and parse("7" * 5_000) == ("7" * 5_000,) and parse(DEEP[:-1]) is None
    df = spark.createDataFrame([(i, datetime(2025, 1, 1), t) for i, t in texts], "record_id bigint, received_at timestamp, payload string")
    got = {tuple(r) for r in child_links(df).collect()}
    assert got == {(i, "asset", str(i), 0, "a") for i in (1, 2, 3)} | {(i, "finding", "a", 0, "F") for i in (1, 2, 3)}
