import random
import re

import pytest

from kinetide.llm import licence as L
from tests.compare import difference, duck

MIT = L.TEMPLATES[1][1]


def plain(template: str, optional: bool, var: str) -> str:
    """A template's wording with or without its optional regions, ``var`` for the replaceable ones."""
    while True:
        inner = re.sub(f"{L.OPT}((?:(?!{L.OPT}).)*?){L.END}", r" \1 " if optional else " ", template, flags=re.S)
        if inner == template:
            return re.sub("<<var.*?>>", var, template)
        template = inner


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def truth(text):
    w = words(text)
    said = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = {label: said(p) for label, p in L.PHRASES.items()}
    places = sorted(i for x in base.values() for i in x)
    line = "".join(f" {x}" for x in w) + " "
    hits = [(label, L.mandatory(L.parsed(t))) for label, t in L.RULES if re.search(L.regex(L.parsed(t)) + " ", line)]
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, x in base.items() if x)), ",".join(sorted({h for h, _ in hits})), max([min(1.0, n / 8) for _, n in hits], default=0.0)


TEXTS = [
    None, "", "...", "MIT License", "mit  LICENSE. MIT\nlicense mit", "Released under the MIT License.", "İ K ſ MIT Licenſe mit licence", "the MIT-license and Apache/License, CC BY-NC 4.0 cc_by ccby",
    "GNU General Public License GNU General Public", "This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "SPDX-License-Identifier: Apache", "SPDX-License-Identifier:", plain(MIT, True, "2020 Some Body"), plain(MIT, False, ""), plain(MIT, False, "").replace("sublicense", "relicense"), plain(MIT, True, "w " * 30), plain(MIT, True, "w " * 31),
    *[plain(t, o, "x") for _, t in L.TEMPLATES for o in (True, False)], "word " * 50_000 + "mit license", "x" * 200_000 + " Apache License", "under " * 3000 + "the " * 3000 + "mit license",
]


def test_texts_and_rows(spark, tmp_path):
    r = random.Random(3)
    vocabulary = "under the mit license apache version 2 0 cc by nc 4 gnu general public terms of x lesser spdx identifier".split()
    texts = TEXTS + [" ".join(r.choice(vocabulary) for _ in range(r.randrange(40))) for _ in range(300)]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, texts[5], "clash", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, labels string, spans int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op11_licence(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((k, *truth(t))) for k, t, *_ in rows)


def test_regions():
    full = len(L.words_of(plain(MIT, False, "")))
    only = L.Scanner((("mit", MIT),)).automaton
    assert only.matches(L.words_of(plain(MIT, False, ""))) == {0: full}
    assert only.matches(L.words_of(plain(MIT, True, "a b") + " and more")) == {0: len(L.words_of(plain(MIT, True, "a b")))}
    assert only.matches(L.words_of(plain(MIT, False, "").replace("hereby", "thereby"))) == {}
    own = L.Scanner((("a", f"a {L.OPT}b {L.OPT}c{L.END}{L.END} d <<var;name=v;least=1;most=2>> e"),)).automaton
    ends = {t: own.matches(t.encode().split()) for t in ("a d x e", "a b d x y e", "a b c d x e", "a c d x e", "a d e", "a d x y z e", "a d e e e")}
    assert {t for t, found in ends.items() if found} == {"a d x e", "a b d x y e", "a b c d x e", "a d e e e"} and ends["a d e e e"] == {0: 5}


@pytest.mark.parametrize("bad", [f"a {L.OPT} b", f"a b {L.END}", "<<var;name=x;least=0;most=3>> a", f"{L.OPT}a{L.END}", "a <<odd>> b"])
def test_markup_that_is_an_error(bad):
    with pytest.raises(ValueError):
        L.Automaton([L.parsed(bad)])


def test_empty_table(spark):
    assert L.labelled(L.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_same_as_sql(spark, sf_dir):
    assert difference(L.op11_licence, L.OP11_SQL, spark, sf_dir, duck(sf_dir)) == ""
