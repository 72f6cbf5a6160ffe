import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.operators import nested
from marketframe.streaming.landing import landed_stream, write_odds

PERSON = nested.struct(
    {"name": nested.STRING, "age": T.LongType(), "address": nested.struct({"street": nested.STRING, "city": nested.STRING}, {"zipcode": nested.STRING})},
    {"phone_numbers": T.ArrayType(nested.STRING)},
)
EVENT = {
    "id": "e1", "sport_key": "k", "sport_title": "t", "commence_time": "c", "home_team": "h", "away_team": "a",
    "bookmakers": [
        {"key": "b1", "title": "B1", "markets": [{"key": "m1", "last_update": "u", "outcomes": [{"name": "x", "price": 2}, {"name": "y", "price": 1.5, "point": 3}]}]},
        {"key": "b2", "title": "B2", "markets": []},
    ],
}


def parse(spark, records, kind=PERSON, **how):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return nested.parsed(spark.createDataFrame(texts, "json string"), "json", kind, **how)


GOOD = {"name": "A", "age": 3, "address": {"street": "s", "city": "c"}, "extra": 1}


def test_parse(spark):
    got = parse(spark, [GOOD, GOOD | {"phone_numbers": None}, GOOD | {"phone_numbers": ["1"]}]).collect()
    assert all(r.violations == [] for r in got)
    assert got[0].record.address.zipcode is None and got[2].record.phone_numbers == ["1"]


@pytest.mark.parametrize(
    ("change", "wrong"),
    [({"age": "x"}, "wrong type age"), ({"name": None}, "missing name"), ({"address": {"street": "s"}}, "missing address.city"), ({"phone_numbers": [5]}, "wrong type phone_numbers[]")],
)
def test_violations(spark, change, wrong):
    assert parse(spark, [GOOD | change]).first().violations == [wrong]
    with pytest.raises(Exception, match="invalid record"):
        parse(spark, [GOOD | change], strict=True).collect()


def test_missing_and_broken(spark):
    got = parse(spark, ["{}", "{"]).collect()
    assert got[0].violations == ["missing name", "missing age", "missing address"] and got[1].violations == ["no JSON"]


def test_defaults(spark):
    kind = nested.struct({}, {"retries": T.LongType(), "timeout": T.LongType()})
    assert parse(spark, [{"timeout": 5}], kind, defaults={"retries": F.lit(3).cast("bigint")}).first().record[:] == (3, 5)


@pytest.mark.parametrize(("payload", "record"), [("event", EVENT), ("historical_event", {"timestamp": "1", "previous_timestamp": "0", "next_timestamp": "2", "data": EVENT}), ("sports", {"key": "k", "group": "g", "title": "t", "description": "d", "active": True, "has_outrights": False})])
def test_payloads(spark, payload, record):
    assert parse(spark, [record], nested.PAYLOADS[payload]).first().violations == []


def test_nested_violation(spark):
    got = parse(spark, [{"timestamp": "1", "previous_timestamp": "0", "next_timestamp": "2", "data": {}}], nested.HISTORICAL_EVENT).first()
    assert "missing data.id" in got.violations


def test_flatten(spark):
    df = spark.createDataFrame([(1, "A", [("s1", "c1"), ("s2", "c2")], [7, 8]), (2, "B", [], None)], "id int, name string, addresses array<struct<street:string,city:string>>, n array<int>")
    got = nested.flattened(df).orderBy("id", "addresses_street").collect()
    assert [(r.id, r.addresses_street, r.n) for r in got] == [(1, "s1", [7, 8]), (1, "s2", [7, 8]), (2, None, None)]
    clash = spark.createDataFrame([("outer", ("inner",))], "key string, m struct<key:string>")
    assert nested.flattened(clash).columns == ["key", "m_key"]
    assert nested.flattened(clash, collisions="last").first()[:] == ("inner",)


def test_product(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([], ["a"])], "x array<int>, y array<string>")
    assert nested.merged(df, ["x", "y"]).count() == 5


def test_odds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(EVENT))
    got = nested.odds_table(nested.landed(spark, str(tmp_path / "in"), "event")).orderBy("bookmaker_key", "outcome_name").collect()
    assert [(r.bookmaker_key, r.market_key, r.outcome_name, r.outcome_price, r.outcome_point) for r in got] == [("b1", "m1", "x", 2.0, None), ("b1", "m1", "y", 1.5, 3.0), ("b2", None, None, None, None)]


def test_odds_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    go = lambda: write_odds(landed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(EVENT | {"id": f"e{i}"}))
        assert go()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * i


def test_sports_list(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"key": "a"}, {"key": "b"}]))
    assert nested.landed(spark, str(tmp_path / "s.json"), "sports").count() == 2
