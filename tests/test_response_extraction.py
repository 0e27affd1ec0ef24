"""Response extraction against a row-by-row restatement, and on very deep and very long answers."""

import json
import random
import re
import time

from casespark.operators import responses as RS
from pyspark.sql import functions as F


def fix(text):
    text = re.sub(r"//[^\n]*", "", text)
    text = re.sub(r"(\s*)([A-Z]\d{1,3}\.?\d*)(,|\s*[\]\}])", r'\1"\2"\3', text, flags=re.A)
    text = re.sub(r",(\s*[\]\}])", r"\1", text, flags=re.A)
    text = re.sub(r"\s+", " ", text, flags=re.A)
    return re.sub(r"\s*([,\[\]{}:])\s*", r"\1", text, flags=re.A)


def load(text):
    try:
        return json.loads(text), True
    except ValueError:
        return None, False


def first_object(text):
    depth, quoted, skip = 0, False, False
    at = text.find("{")
    for i in range(at, len(text)) if at >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[at:i + 1]
    return None


def lists(value):
    if isinstance(value, dict) and isinstance(value.get("top10"), list) and isinstance(value.get("predictions"), list):
        if value["top10"] and value["predictions"]:
            return [x.split(":", 1)[0].strip(" \t\n\x0b\x0c\r") for x in value["top10"]]
    return None


def last_match(text):
    """Method and ranked list by the rules of the second profile."""
    fenced = re.findall(r"```json\n(.*?)\n```", text, re.S)
    if fenced:
        for attempt in (fenced[-1], fix(fenced[-1])):
            value, ok = load(attempt)
            if ok:
                return "fenced", lists(value)
        return "fenced", None
    value, ok = load(text.strip(" \t\n\x0b\x0c\r"))
    if ok:
        return "whole", lists(value)
    lines = [line.strip(" \t\n\x0b\x0c\r") for line in text.split("\n")]
    good = [v for line in lines if line.startswith("{") and line.endswith("}") for v, ok in [load(line)] if ok]
    if good:
        return "line", lists(good[-1])
    greedy = re.search(r"\{.*\}", text, re.S)
    for method, candidate in (("greedy", greedy and greedy[0]), ("balanced", first_object(text))):
        if candidate:
            for attempt in (fix(candidate), candidate):
                value, ok = load(attempt)
                if ok:
                    return method, lists(value)
    short = re.findall(r"\{.*?\}", text, re.S)
    if short:
        for attempt in (short[-1], fix(short[-1])):
            value, ok = load(attempt)
            if ok:
                return "braces", lists(value)
        return "braces", None
    return None, None


def extract(spark, texts, profile="last_match"):
    log = spark.createDataFrame(list(enumerate(texts)), "case_id long, response string")
    rows = RS.extract_responses(log, profile).select("case_id", "status", "method", "ranked").collect()
    return [(r.status, r.method, r.ranked) for r in sorted(rows)]


OBJECT = '{"top10": ["A1: x", " B2"], "predictions": ["A1"]}'
PIECES = [OBJECT, OBJECT, OBJECT[:-1] + ",}", '{"top10": [A10, B20.5], "predictions": [A10]}', '{"top10": [], "predictions": []}',
          '{"a": {"b": "}{"}, "top10": ["C3"], "predictions": ["C3"]}', '{"x": "\\"}"}', "{", "}", '"', "\\", "\n", "```json\n", "\n```", "text ",
          "// note }\n", '["list"]', "12", "[" + OBJECT + "]", "]", ",", '{"top10": ["D4"], // why\n"predictions": ["D4"]}', "{}", " "]


def test_last_match_equals_row_by_row_rules(spark):
    rng = random.Random(7)
    texts = list(dict.fromkeys("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 6))) for _ in range(4000))) + PIECES + [""]
    for text, got in zip(texts, extract(spark, texts)):
        method, ranked = last_match(text)
        assert got == ("valid" if ranked else "invalid", method, ranked or None), text


def test_balanced_object_equals_a_scan(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['{', '}', '"', "\\", "a", "\n", "\\\"", "{\"", "\"}", "é😀"]) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", RS.balanced_object("t").alias("b"))
    assert {r.i: r.b for r in df.collect()} == {i: first_object(t) for i, t in enumerate(texts)}


def deep_answer(levels, length=0):
    inner = '{"a":' * (levels - 1) + '"' + "}{" * (length // 2) + '"' + "}" * (levels - 1)
    return '{"steps":' + inner + ', "top10": ["A1", "B2"], "predictions": ["A1"]}'


def test_deep_and_long_answers_on_both_profiles(spark):
    for levels, length in ((13, 0), (1000, 0), (5000, 0), (20, 1_000_000), (1000, 1_000_000)):
        answer = deep_answer(levels, length)
        texts = [f"So:\n```json\n{answer}\n```", answer]
        want = ("valid", ["A1", "B2"])
        assert [(s, r) for s, _, r in extract(spark, texts, "one_match")][0] == want
        assert [(s, r) for s, _, r in extract(spark, texts)] == [want, want]
        # repaired (trailing comma), found by the greedy pattern and by the depth of braces
        broken = answer[:-1] + ", }"
        assert extract(spark, ["See " + broken, "See " + broken + " and } later"]) == [
            ("valid", "greedy", want[1]), ("valid", "balanced", want[1])]


def test_time_of_long_answers_grows_with_the_length(spark):
    def seconds(n):
        text = "{ " + '{"a": [1, 2]} , ' * (n // 16) + " " * 1000
        began = time.perf_counter()
        assert extract(spark, [text])[0][0] == "invalid"
        return time.perf_counter() - began
    seconds(20_000)
    assert seconds(1_000_000) < 20 + 50 * seconds(20_000)


def test_trailing_brackets_are_not_valid_json(spark):
    texts = [OBJECT + "]", OBJECT + "],[{}", OBJECT, "[1]", "1", '"x"', "", "null", OBJECT + ",{}", "{}]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.v for r in df.select("i", RS.valid_json("t").alias("v")).collect()}
    assert got == {i: load(t)[1] for i, t in enumerate(texts)}
    objects = {r.i: r.v for r in df.select("i", RS.parse_object("t", "top10").isNotNull().alias("v")).collect()}
    assert objects == {i: isinstance(load(t)[0], dict) for i, t in enumerate(texts)}


def test_null_and_blank_responses(spark):
    log = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "case_id long, response string")
    for profile in ("one_match", "last_match"):
        assert {(r.status, r.method) for r in RS.extract_responses(log, profile).collect()} == {("invalid", None)}
    assert RS.extract_responses(log.filter(F.lit(False)), "last_match").collect() == []
