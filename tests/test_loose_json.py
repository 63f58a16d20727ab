"""Loosely written JSON and YAML."""

import json
import random

import pytest

from tracemill.functions.loose_json import read_object, repaired

SHAPES = [
    ('{"a": "he said "no" to it", "b": 1}', {"a": 'he said "no" to it', "b": 1}),
    ("a: 1\nb: [x, y]", {"a": 1, "b": ["x", "y"]}),
    ("{'a': 'it''s', 'b': True}", {"a": "it's", "b": True}),
    (' <judge\\_result>\n{\n "is\\_secure": true,\n "confidence": "HIGH",\n "findings": []\n}\n</judge\\_result>', {"is_secure": True, "confidence": "HIGH", "findings": []}),
    ('<judge_result>{"is_secure": false,"evidence": "line=18: any(p in s for p in ["os.system", "subprocess.run"])"}</judge_result>', {"is_secure": False, "evidence": 'line=18: any(p in s for p in ["os.system", "subprocess.run"])'}),
    ('<judge_result>{"a": 1, "b": [1,2,],}</judge_result>', {"a": 1, "b": [1, 2]}),
    ("<json_payload>{&quot;a&quot;: [1, 2,]}</json_payload>", {"a": [1, 2]}),
    ("Verdict:\n```json\n{\"a\": {\"b\": [1, {\"c\": null}]}}\n```\nthat's all", {"a": {"b": [1, {"c": None}]}}),
    ('use {x y z: } or so, then {"a": 1} it is }', {"a": 1}),
    ("{a: 1, b_c: 'x', d: , e}", {"a": 1, "b_c": "x", "d": None, "e": None}),
    ("score: 0.5 # of one\nlist:\n  - one\n  - k: v\n    w: 'a: b'\n  -\n    - 1\n    - [2, [yes]]\ntext: |\n  two\n   lines\nfold: >-\n  two\n  lines\nlong: goes\n  on\n'q k': \"x\\ty\"\nnone: ~\ne: 1e3\n", {"score": 0.5, "list": ["one", {"k": "v", "w": "a: b"}, [1, [2, [True]]]], "text": "two\n lines\n", "fold": "two lines", "long": "goes on", "q k": "x\ty", "none": None, "e": 1000.0}),
    ("list:\n- a: 1\n  b: 2\n- c\nafter: 3", {"list": [{"a": 1, "b": 2}, "c"], "after": 3}),
    ('{"u": "\\ud83d\\ude00 \\u00e9", "n": -1.5e-3, "t": "a\n b"}', {"u": "😀 é", "n": -0.0015, "t": "a b"}),
]
NONE = [None, "", "   ", "no object here", "[1, 2]", "{", '{"a": ', "a: b: c", "- 1\n- 2", "key\n  more: x: y", "&x: *y" if False else "a: &x 1", "{" * 5000, "[" * 5000 + "]" * 5000, "{a: [1}"]


@pytest.mark.parametrize("text,expected", SHAPES)
def test_shapes(text, expected):
    assert read_object(text) == expected


@pytest.mark.parametrize("text", NONE)
def test_texts_without_an_object(text):
    assert read_object(text) is None and repaired(text) is None


def nested(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([rng.randrange(-1000, 1000), round(rng.uniform(-5, 5), 3)])
    if kind <= 3:
        return "".join(rng.choice("ab é\"'\\/:,{}[]#-\n\t😀") for _ in range(rng.randrange(6)))
    if kind == 4:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"k{n}" if rng.random() < 0.8 else f"odd: {n}": nested(rng, depth - 1) for n in range(rng.randrange(1, 4))}


def flow(x, rng):
    """The same value, loosely: single quotes, Python's words, bare keys, trailing commas and odd spaces."""
    gap = lambda: rng.choice(["", " ", "\n "])
    if isinstance(x, dict):
        items = [f"{k if k.startswith('k') and rng.random() < 0.5 else json.dumps(k)}{gap()}: {flow(v, rng)}{gap()}" for k, v in x.items()]
        return "{" + gap() + ",".join(items) + rng.choice(["", ",", " , "]) * bool(items) + gap() + "}"
    if isinstance(x, list):
        return "[" + ",".join(gap() + flow(v, rng) for v in x) + rng.choice(["", ","]) * bool(x) + "]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'" if "\n" not in x and rng.random() < 0.5 else json.dumps(x)
    return rng.choice([json.dumps(x), repr(x)])


def block(x, indent, rng):
    """The same value as block YAML, after its key."""
    pad = " " * indent
    if isinstance(x, dict) and x:
        return "\n" + "\n".join(f"{pad}{k if k.startswith('k') else json.dumps(k)}:{block(v, indent + rng.choice([1, 2, 4]), rng)}" for k, v in x.items())
    if isinstance(x, list) and x:
        return "\n" + "\n".join(f"{pad}-{block(v, indent + rng.choice([1, 2]), rng)}" for v in x)
    return " " + json.dumps(x, ensure_ascii=False)


def test_random_objects_in_loose_shapes():
    rng = random.Random(8)
    for _ in range(2000):
        x = {f"k{n}": nested(rng, 3) for n in range(rng.randrange(1, 4))}
        assert read_object(json.dumps(x)) == x
        assert read_object("Here:\n" + json.dumps(x, indent=1) + "\nDone.") == x
        assert read_object(flow(x, rng)) == x
        written = block(x, 0, rng).strip("\n")
        if "{" not in written:
            assert read_object(written) == x, written


def test_inner_quotations_of_any_number():
    rng = random.Random(9)
    for _ in range(500):
        words = [rng.choice(["a", "bb", "c d"]) for _ in range(rng.randrange(1, 6))]
        said = " ".join(f'"{w}"' if rng.random() < 0.5 else w for w in words)
        text = f"say {said} so"
        assert read_object(f'{{"x": "{text}", "y": ["{text}", 2]}}') == {"x": text, "y": [text, 2]}
