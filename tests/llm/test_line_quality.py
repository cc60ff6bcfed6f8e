"""Line rules against counts by hand; the SQL twin covers whole tables."""

import re

from quarrygraph.llm import line_quality as Q

CLEAN = "\n".join(" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(14)) + "." for i in range(9))


def test_base_counts_by_hand(awkward, clashing, empty):
    for r in Q.judge(awkward).collect():
        text = next((x.text for x in awkward.collect() if x.doc_id == r.doc_id), None) or "" if r.doc_id is not None else None
        if text is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, covered = {}, set()
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + o for p in places for o in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert Q.judge(clashing).count() == awkward.count() and Q.judge(empty).count() == 0


def test_lines(spark):
    lines = {"nav": "Home | News | Sport | Weather | Contact", "symbols": "a### b$$$ c%%% d&&&", "shout": "BUY!! NOW!! OR!! NEVER!!", "stuck": "word " * 30, "cookie": "Read our cookie policy.", "unstopped": "a b c d e f g h i j k l m n"}
    docs = spark.createDataFrame([(i, CLEAN + "\n" + t) for i, t in enumerate(lines.values())] + [(99, CLEAN), (100, "\n".join([*lines.values()] * 9) + "\n" + CLEAN)], "doc_id long, text string")
    out = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert all(out[i].lines_removed == 1 and out[i].kept and out[i].clean_text == CLEAN for i in range(len(lines)))
    assert out[99].lines_removed == 0 and out[99].kept and not out[100].kept
