import duckdb
import pytest

from framewise.llm import license_scan as ls


def test_markup():
    a = ls.compile_template("x", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four <<var;name=v;original=o;match=.{1,2}>> five")
    good = ["one four q five", "one two four q r five", "one two three four q five"]
    bad = ["one three four q five", "one four five", "one four q r s five", "one two four q fiv"]
    assert all(a.read(t.split(), 0)[0] > 0 for t in good) and all(a.read(t.split(), 0)[0] < 0 for t in bad)
    assert a.mandatory() == 3 and a.read("one four q fiv".split(), 0)[1] == 2
    for t in ("<<endOptional>>", "<<beginOptional>> x"):
        with pytest.raises(ValueError):
            ls.compile_template("x", t)


def test_labels():
    s = ls.Scanner()
    assert s.scan("Released under the MIT License.")[4:] == (["mit"], ["mit"], 1.0)
    assert s.scan("This work is licensed under the GNU General Public License, version 3.")[4:] == ([], ["gpl-3"], 1.0)
    n, places, first, last, base, labels, _ = s.scan("CC BY-NC 4.0; under the MIT--license, cc/by/nc")
    assert (n, places, first, last, base) == (12, 3, 0, 9, ["cc-by-nc", "mit"]) and set(base) <= set(labels)
    assert s.scan("")[:4] == (0, 0, None, None) and s.scan("licensed under the sea")[6] < 1


def test_sql(spark, docs, odd, empty):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.sql(ls.ORACLE + " ORDER BY 1").fetchall()}
    for r in ls.op8(spark, docs).collect():
        assert tuple(r)[1:] == want[r.doc_id]
    assert ls.op8(spark, odd).count() == odd.count() and ls.op8(spark, empty).count() == 0


def plain(template):
    """A template's own wording: optional parts out, replaceable ones in their original."""
    import re

    return re.sub(r"<<var;name=\w+;original=([^;]*);match=[^>]*>>", r"\1", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template))


def test_mandatory_wording(spark):
    """Every template accepts its own wording within other text, and no longer once any mandatory word is altered."""
    import random

    rng, rows = random.Random(3), []
    for label, many in ls.TEMPLATES.items():
        for t in many:
            text, scanner = f"x y {plain(t)} z", ls.Scanner({label: [t]}, {})
            assert scanner.scan(text)[5] == [label] and scanner.scan(text)[6] == 1.0
            rows.append(text)
            fixed = [w for w in ls.words_of(re_fixed(t))]
            words = ls.words_of(text)
            for w in rng.sample(fixed, min(8, len(fixed))):
                at = words.index(w)
                if words.count(w) == 1:
                    altered = " ".join([*words[:at], w + "q", *words[at + 1 :]])
                    assert scanner.scan(altered)[5] == [] and scanner.scan(altered)[6] < 1.0
                    rows.append(altered)
    # The registered SQL agrees on all of these, scores included.
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").toPandas())
    want = {r[0]: r[1:] for r in con.sql(ls.ORACLE).fetchall()}
    for i, text in enumerate(rows):
        n, places, first, last, base, labels, score = ls.Scanner().scan(text)
        assert (n, places, first, last, ",".join(base), ",".join(labels), score) == want[i]


def re_fixed(template):
    """The mandatory words alone."""
    import re

    return re.sub(r"<<var;[^>]*>>", " ", re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", template))
