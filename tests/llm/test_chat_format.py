"""The template compiler, escaping, and reading back."""

import hashlib
import random

import pyarrow as pa
import pytest

from quarrygraph.llm import chat_format as C


def render(source, **given):
    return "".join(t for t, _ in C.compile_template(source)(given))


def test_language():
    assert render("{% for x in xs %}{{ loop.index0 }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": None}]) == "0p,1"
    assert render("{% if a == 1 and b %}x{% elif c > 2 %}y{% else %}z{% endif %}", a=1, b="", c=3) == "y"
    assert render("{% set t = 'q' ~ 1 %}{{ t }}{# gone #}{{ 1 + 2 * 3 }}") == "q17"
    assert render("{{ m['k'] | upper }}{{ m.none | string }}", m={"k": "ab"}) == "ABNone"
    assert [m for _, m in C.compile_template("a{% generation %}b{% endgeneration %}c")({})] == [False, True, False]
    assert C.parse("{{ 'a' ~ 'b' }}{% if 1 == 1 %}c{% endif %}{% if false %}d{% endif %}e") == [("text", "abce")]
    assert render("{% for x in xs %}{{ x }}{% endfor %}", xs=iter("abc")) == "abc"
    assert render("a \n{%- if x -%}\n b \n{{- y -}} \n c{#- gone -#} d\n{%- endif %} e", x=1, y="Y") == "ab Y cd e".replace("b Y c", "bYc")


@pytest.mark.parametrize("bad", ["{{ f() }}", "{{ x.__class__ }}", "{{ _x }}", "{{ x | nope }}", "{% for x in %}{% endfor %}", "{% if x %}", "{% import os %}", "{{ 1 + }}", "{{ 'a' * 99 }}", "{{ $ }}", "{{ 'a' + 1 }}"])
def test_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_every_mix_of_control_strings_comes_back(monkeypatch):
    monkeypatch.setattr(C, "_SEGMENT_CHARS", 7)
    rnd = random.Random(1)
    parts = [*C.CONTROL, "\\", "<", "|", "s>", "[", "\n", "%", "im_end", "x", "é\U0001f600"]
    for _ in range(400):
        turns = [(rnd.choice(["assistant", "user", "".join(rnd.choice(parts) for _ in range(3))]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for _ in range(rnd.randint(1, 4))]
        batch = pa.RecordBatch.from_arrays([pa.array([1] * len(turns)), pa.array([r for r, _ in turns]), pa.array([t for _, t in turns])], names=list("abc"))
        out = [tuple(r.values()) for b in C._digester(C._renderer(C.TEMPLATE)(iter([batch]))) for r in b.to_pylist()]
        loss = "".join(t for r, t in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert [o[:5] for o in out] == [(1, len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())]


def test_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "user", "s"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t"), (4, 0, "assistant", "y" * 600_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'z' AS spans")
    out = {r.conv_id: r for r in C.read_back(C.format_conversations(turns)).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 2, 2: 1, None: 1, 3: 3, 4: 1}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and out[4].loss_chars == 600_000
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and out[3].loss_chars == 2
    assert C.read_back(C.format_conversations(turns.limit(0))).count() == 0


def test_stored_segments_are_read_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(C, "_SEGMENT_CHARS", 40)
    turns = [(c, t, r, f"text {c} {t} " * 9) for c in range(9) for t, r in enumerate(("user", "assistant", "user"))]
    segments = C.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = segments.collect()
    random.Random(3).shuffle(rows)
    want = sorted(map(tuple, C.read_back(segments, as_written=True).collect()))
    again = spark.createDataFrame(rows, segments.schema).repartition(3)
    assert sorted(map(tuple, C.read_back(again).collect())) == want and len(want) == 9
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 2], "seq": [0, 1], "text": ["", ""], "spans": [[], []]})
    with pytest.raises(ValueError):
        list(C._digester(iter([batch])))
