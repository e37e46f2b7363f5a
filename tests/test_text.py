import base64
import json

from pyspark.sql import functions as F

from fathomline.functions import text, times


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(build(F.col("c"))).first()[0]


def test_fingerprints(spark):
    cases = {
        "served 192.168.0.1:80 in 12345ms\nnext": "served <IP> in 12345ms",
        "code 404 after 2026-05-03T15:34:55.425Z": "code 404 after <TIME>",
        "GET /x?token=abc&y=1 done": "GET /x?<Q> done",
        "trace 5a17c0de5a17c0de5a17c0de5a17c0de": "trace <HEX32>",
        "id 0f8fad5b-d9cb-469f-a165-70867728950e": "id <UUID>",
        "seq 17731024621731": "seq <N>",
        "at 1773102462173": "at <TIME_MS>",
        "ulid 01ARZ3NDEKTSV4RRFFQ69G5FAV": "ulid <ULID>",
        "span 00f067aa0ba902b7": "span <HEX16>",
        "n 4711  rows": "n <N> rows",
    }
    for line, want in cases.items():
        assert one(spark, line, text.fingerprint) == want
    assert one(spark, None, text.fingerprint) == ""
    assert len(one(spark, "x" * 400, text.fingerprint)) == 301


def token(header):
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    return f"{part(header)}.{part({'sub': 1})}.sig-nature"


def test_masks(spark):
    cases = {
        f"a {token({'alg': 'RS256', 'kid': 'A'})} b": "a <JWT kid=A alg=RS256> b",
        "a eyJxx.eyJyy.zz b": "a <JWT> b",
        "https://u:p@host/x": "https://<CRED>@host/x",
        "id 990101199001011234 ok": "id <ID_CARD> ok",
        "13812345678": "<PHONE>",
        "13812345678,13912345678 13712345678": "<PHONE>,<PHONE> <PHONE>",
        "打13812345678没人接": "打13812345678没人接",
        "a@b.co": "<EMAIL>",
        "10.0.0.1 stays": "10.0.0.1 stays",
    }
    for raw, want in cases.items():
        once = one(spark, raw, text.mask)
        assert once == want
        assert one(spark, once, text.mask) == once
    assert one(spark, None, text.mask) is None


def test_small_functions(spark):
    assert one(spark, "01ARZ3NDEKTSV4RRFFQ69G5FAV", text.ulid_millis) == 1469922850259
    assert one(spark, "not one", text.ulid_millis) is None
    assert one(spark, "500MB", text.byte_size) == 500 * 2**20
    assert one(spark, "1.5 g", text.byte_size) == int(1.5 * 2**30)
    assert one(spark, "lots", text.byte_size) is None
    assert one(spark, "```json\n{\"a\": 1}\n```", text.without_fences) == '{"a": 1}'
    assert one(spark, "x <tool_call>{}</tool_call> y <tool_call>{", text.without_tool_tags) == "x  y"
    assert one(spark, "/a/b.go:12: x", text.caller_place) == "/a/b.go:N: x"
    assert one(spark, "Host 消息 a_1!", text.words) == ["host", "消", "息", "a_1"]
    assert one(spark, "　 a \t b ", text.squeeze) == "a b"
    assert one(spark, "​ ﻿", text.is_blank) is True


def test_snippets(spark):
    body = "x" * 200 + " needle " + "y" * 200
    assert "needle" in one(spark, body, lambda c: text.snippet(c, F.array(F.lit("absent"), F.lit("needle"))))
    assert one(spark, body, lambda c: text.snippet(c, F.array(F.lit("absent")))) == "x" * 120


def test_times(spark):
    ms = lambda c: F.unix_millis(times.parsed(c))
    assert one(spark, "2026-06-17T13:49:53Z", ms) == one(spark, "2026-06-17T21:49:53+08:00", ms)
    assert one(spark, "2026-06-17 21:49:53", ms) == one(spark, "2026-06-17T13:49:53Z", ms)
    assert one(spark, "yesterday", ms) is None
    assert one(spark, None, ms) is None
