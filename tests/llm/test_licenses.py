import functools
import textwrap

import pytest

from halocline.llm.licenses import TEMPLATES, normalised_words, scan_licenses, template_bigrams

from .helpers import EXTRA, docs


def brute(text, threshold=0.8, templates=TEMPLATES):
    """(line, last line, name, dice) by comparing everything with everything."""
    if text is None:
        return []
    split = lambda x: [w for w in normalised_words(x) if w]
    lines = [split(x) for x in text.split("\n")]
    words, starts = [w for x in lines for w in x], [sum(map(len, lines[:k])) for k in range(len(lines))]
    grams = template_bigrams(templates)

    def dice(w, name):
        a = {f"{x} {y}" for x, y in zip(w, w[1:])}
        return 2 * len(a & set(grams[name])) / (len(a) + len(grams[name])) if a and grams[name] else 0

    def best(w):
        return min((-dice(w, n), n) for n in grams)

    whole = [(0, len(lines), *best(words))] if len(lines) > 1 else []
    found = [(d, False, k + 1, n, starts[k], starts[k] + len(x)) for k, x in enumerate(lines) for d, n in [best(x)] if d <= -threshold]
    for k, x in enumerate(lines):
        for n in grams:
            size = len(split(templates[n]))
            if 0 < len(x) < size and starts[k] + len(x) < len(words):
                end = min(len(words), starts[k] + size)
                d = -dice(words[starts[k] : end], n)
                if d <= -threshold:
                    found.append((d, True, k + 1, n, starts[k], end))
    # spans that stay: those for which every better one that they meet had to go
    @functools.cache
    def stays(x):
        return not x[1] or not any(y < x and y[4] < x[5] and x[4] < y[5] and stays(y) for y in found)

    kept = [x for x in found if stays(x)]
    out = [(0, last, n, round(-d, 9)) for _, last, d, n in whole if d <= -threshold]
    return out + [(x[2], sum(s < x[5] for s in starts) if x[1] else x[2], x[3], round(-x[0], 9)) for x in kept]


def found(spark, texts, schema=EXTRA):
    rows = scan_licenses(docs(spark, texts, schema)).collect()
    return sorted((r.doc_id, r.line, r.last_line, r.license_id, round(r.dice, 9)) for r in rows)


def test_every_template_is_found_in_itself_and_near_itself(spark):
    texts = []
    for t in TEMPLATES.values():
        w = t.split()
        texts += [t, "x\n" + t.upper() + "\ny", " ".join(w[: -max(1, len(w) // 12)]), t + " and more", "  " + t.replace(" ", " ,\t")]
    want = sorted((k, *row) for k, t in enumerate(texts) for row in brute(t))
    assert found(spark, texts) == want
    assert {r[3] for r in want} == set(TEMPLATES)


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices_inside_longer_texts(spark, width):
    texts = []
    for k, t in enumerate(TEMPLATES.values()):
        comment = ["", "# ", " * "][k % 3]
        body = "\n".join(comment + x for x in textwrap.wrap(t, width))
        texts.append("import os\n\n" * (k % 2) + f"{body}\n\ndef main():\n" + "    return some(value, other, 1)\n" * 30)
    want = sorted((k, *row) for k, t in enumerate(texts) for row in brute(t))
    assert found(spark, texts) == want
    assert {r[3] for r in want} == set(TEMPLATES)


def test_a_span_that_gives_way_hides_no_other(spark):
    """A notice right behind another, with another last line: the spans in between overlap both, and go."""
    notice = "\n".join(textwrap.wrap(TEMPLATES["MIT"], 60))
    edited = notice.rsplit("\n", 1)[0] + "\nwith no promise at all"
    for between in ("\n", "\nx\n", "\n\n"):
        text = "code here\n" + notice + between + edited + "\nreturn value\n" * 9
        got = [r for r in found(spark, [text]) if r[3] == "MIT" and r[1] > 0]
        assert got == [(0, *r) for r in sorted(brute(text)) if r[2] == "MIT" and r[0] > 0]
        second = 2 + notice.count("\n") + between.count("\n")
        assert len(got) == 2 and got[0][1] == 2 and got[1][1] in (second - 1, second)


def test_overlapping_spans_small_templates_and_no_templates(spark):
    templates = {"ab": "a b", "one": "one", "long": "a b c d e f g h i j", "twin": "a b c d e f g h i j"}
    texts = ["a\nb", "a b", "x\na b c d\ne f g h i j\na b", "a b c d\n\ne f\ng h i\nj k l", "a b c d e\nf g h i\na b c d e f\ng h i j"]
    got = sorted((r.doc_id, r.line, r.last_line, r.license_id, round(r.dice, 9)) for r in scan_licenses(docs(spark, texts, EXTRA), templates).collect())
    assert got == sorted((k, *row) for k, t in enumerate(texts) for row in brute(t, templates=templates))
    assert (1, 1, 1, "ab", 1.0) in got
    assert scan_licenses(docs(spark, texts), {}).count() == 0 and scan_licenses(docs(spark, texts), {"one": "one"}).count() == 0


def test_texts_without_findings(spark):
    assert found(spark, [None, "", " ", "one", "\n\n", "é", "All rights", "word " * 50_000]) == []


def test_repeated_rows_null_ids_and_long_texts(spark):
    text = "All rights reserved."
    rows = scan_licenses(docs(spark, [(1, text), (1, text), (None, text), (2, "filler\n" * 20_000 + text)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.line) for r in rows) == [(False, 1, 1), (False, 1, 1), (False, 2, 20_001), (True, 0, 1)]


def test_ties_go_to_the_first_name(spark):
    templates = {"b": "one two three", "a": "two one three two"}
    row = scan_licenses(docs(spark, ["one two three"]), {"b": "one two three", "a": "one two three"}).collect()
    assert [r.license_id for r in row] == ["a"]
    assert templates


def test_empty_table_and_plan_without_python(spark):
    df = scan_licenses(docs(spark, []))
    assert df.count() == 0
    plan = scan_licenses(docs(spark, ["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("bad", ["MIT License", "GPL"])
def test_short_mentions_are_no_licence(spark, bad):
    assert found(spark, [f"some text about the {bad} and other things"]) == []
