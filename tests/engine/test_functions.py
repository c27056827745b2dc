import datetime
import decimal
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from slicer.functions import mask
from slicer.functions.identifiers import plain_identifier, quote, quote_table, quoted_list
from slicer.functions.literals import literal
from slicer.functions.sqltypes import affinity, key_type
from slicer.plans.config import Config, Rule


def test_known_vector(spark):
    m = mask.Masker("demo-salt")
    df = spark.createDataFrame([("alice@example.com",)], "v string")
    got = df.select(m.hmac_hex(F.col("v")), *[mask.TRANSFORMS[t](m, F.col("v")) for t in ("fake_email", "hmac_phone", "hmac_name", "hmac_token", "uuid_remap")]).first()
    assert tuple(got) == ("51e84a2ba2aed26b13baae6fa2aaa6469732898d78260de396ac98befb61c3ba", "anon_51e84a2ba2@drain.local", "+155551e84a2", "User_51e84a", "tok_51e84a2ba2aed26b", "51e84a2b-a2ae-426b-93ba-ae6fa2aaa646")


@pytest.mark.parametrize("salt", ["", "s", "x" * 64, "y" * 65, "é" * 50])
def test_hmac_equals_the_library(spark, salt):
    values = ["", "a", "é 中", "x" * 200, None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", mask.Masker(salt).hmac_hex(F.col("v"))).collect()
    for v, h in got:
        assert h == (None if v is None else hmac.new(salt.encode(), v.encode(), hashlib.sha256).hexdigest())


def test_heuristics():
    want = {"email": "fake_email", "work_EMAIL": "fake_email", "emails": None, "phone": "hmac_phone", "mobile_no": "hmac_phone", "first_name": "hmac_name", "last_name": "hmac_last_name", "name": "hmac_name", "full_name": "hmac_name", "username": None, "passwd": "redact_password", "user_password": "redact_password", "api_token": "hmac_token", "secret_x": "hmac_token", "id": None}
    assert {c: mask.heuristic(c) for c in want} == want
    assert mask.looks_private("username") and not mask.looks_private("id")


def test_mask_table(spark):
    df = spark.createDataFrame([(1, "Ann", None, 5), (2, "Ann", "b@x", 6)], "id int, name string, email string, tenant int")
    out = mask.mask_table(df, "t", Config(rules=[Rule("t", "tenant", "uuid_remap"), Rule("t", "email", "no_such")]), mask.Masker("k"))
    a, b = out.orderBy("id").collect()
    assert a.name == b.name and a.name.startswith("User_") and a.email is None and b.email.endswith("@drain.local") and len(a.tenant) == 36
    assert dict(out.dtypes)["tenant"] == "string" and dict(out.dtypes)["id"] == "int"
    assert mask.mask_table(df, "t", masker=mask.Masker("other")).orderBy("id").first().name != a.name
    mask.register("shout", lambda m, v: F.upper(v))
    assert mask.mask_table(df, "t", Config(rules=[Rule("*", "name", "shout")])).first().name == "ANN"
    assert "PythonUDF" not in out._jdf.queryExecution().toString()


def test_literals(spark):
    nasty = "it's \"x\" \\ \n \r \0 \x1a é"
    df = spark.createDataFrame([(True, 7, 1.5, decimal.Decimal("2.50"), nasty, bytearray(b"\xde\xad\xbe\xef"), bytearray(b'{"a": "it\'s"}'), datetime.datetime(2026, 9, 22, 12, 30, 45), datetime.datetime(2026, 9, 22, 12, 30, 45, 120000), datetime.date(2026, 1, 2), [1, 2], None)], "b boolean, i int, d double, n decimal(10,2), s string, raw binary, js binary, t timestamp, u timestamp, day date, arr array<int>, z string")
    of = lambda engine: df.select(*[literal(engine, F.col(f.name), f.dataType, "jsonb" if f.name == "js" else "").alias(f.name) for f in df.schema]).first()
    pg, my, lite = of("postgres"), of("mysql"), of("sqlite")
    assert (pg.b, my.b, lite.b) == ("TRUE", "1", "1") and (pg.i, pg.d, pg.n) == ("7", "1.5", "2.50") and pg.z == my.z == "NULL"
    assert pg.s == "'" + nasty.replace("'", "''") + "'"
    assert my.s == "'it\\'s \\\"x\\\" \\\\ \\n \\r \\0 \\Z é'"
    assert (pg.raw, my.raw, lite.raw) == ("'\\xdeadbeef'", "X'DEADBEEF'", "X'DEADBEEF'")
    assert pg.js == "'{\"a\": \"it''s\"}'" and my.js == "'{\\\"a\\\": \\\"it\\'s\\\"}'"
    assert (pg.t, my.t) == ("'2026-09-22T12:30:45Z'", "'2026-09-22 12:30:45'")
    assert (pg.u, my.u) == ("'2026-09-22T12:30:45.12Z'", "'2026-09-22 12:30:45.120000'")
    assert pg.day == "'2026-01-02'" and pg.arr == "'[1,2]'"
    ids = spark.createDataFrame([(bytearray(bytes(range(16))),)], "u binary")
    assert ids.select(literal("postgres", F.col("u"), ids.schema["u"].dataType, "uuid")).first()[0] == "'00010203-0405-0607-0809-0a0b0c0d0e0f'"


def test_identifiers():
    assert quote("mysql", "a`b") == "`a``b`" and quote("postgres", 'a"b') == '"a""b"'
    assert quote_table("postgres", "public", "t") == '"public"."t"' and quote_table("sqlite", "public", "t") == '"t"' and quote_table("mysql", "", "t") == "`t`"
    assert quoted_list(["a", "b'c"]) == "'a', 'b''c'" and plain_identifier("a-b c") == "a_b_c"


@pytest.mark.parametrize(("declared", "want"), [(t, w) for w, ts in {"TEXT": ["uuid", "json", "jsonb", "enum", "text[]", "integer[]", "inet", "timestamptz", "timestamp without time zone", "datetime", "date", "time", "text", "varchar(255)", "char(3)", "clob", "unknown"], "INTEGER": ["boolean", "bool", "serial", "BIGSERIAL", "int(11)", "integer", "bigint", "smallint", "tinyint", "mediumint", "int8"], "NUMERIC": ["numeric(10,2)", "decimal"], "REAL": ["float", "double", "double precision", "real", "float8"], "BLOB": ["bytea", "blob", "varbinary(16)"]}.items() for t in ts])
def test_affinities(declared, want):
    assert affinity(declared) == want


def test_key_types():
    assert [key_type(t) for t in ("bigint", "int4", "uuid", "varchar(3)", "mediumint")] == ["bigint", "bigint", "uuid", "text", "text"]
