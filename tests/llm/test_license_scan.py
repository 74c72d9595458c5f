from __future__ import annotations

import re

import pytest

from salesledger.llm import license_scan
from salesledger.llm.license_scan import TEMPLATES


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def shingles(words):
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(texts):
    """Every window of a template's length at every position, the best of those that overlap."""
    out = set()
    for doc_id, text in texts:
        words = tokens(text)
        for name, template in TEMPLATES.items():
            wanted, n = shingles(tokens(template)), len(tokens(template))
            places = []
            for start in range(max(0, len(words) - 2)):
                share = len(shingles(words[start : start + n]) & wanted) / len(wanted)
                if share < 0.75:
                    continue
                if not places or places[-1][1] <= start:
                    places.append((start, start + n, share))
                elif places[-1][2] < share:
                    places[-1] = (start, start + n, share)
            out |= {(doc_id, name, *p) for p in places}
    return out


def rows(result):
    return {(r.doc_id, r.license, r.start, r.end, r.containment) for r in result.collect()}


def test_matches_brute_force(spark, documents):
    found = rows(license_scan.scan(documents))
    assert found == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert found


def test_near_and_repeated_notices(spark):
    gpl = TEMPLATES["GPL-3.0"]
    texts = [
        (1, f"x y {gpl} z"),
        (2, gpl.replace("version 3", "version 2")),
        (3, f"{gpl} {gpl}"),
        (4, gpl.upper().replace(" ", "\n")),
        (5, "This work is licensed under terms"),
        (6, TEMPLATES["BSD-3-Clause"].replace("source and", "source or")),
    ]
    found = rows(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")))
    assert found == brute(texts)
    assert {i for i, *_ in found} == {1, 2, 3, 4, 6} and sum(i == 3 for i, *_ in found) == 2


def test_odd_rows_and_bounds(spark, odd_documents):
    notices = [(1, None), (2, ""), (3, TEMPLATES["MIT"]), (3, TEMPLATES["MIT"]), (None, TEMPLATES["MIT"])]
    assert len(license_scan.scan(spark.createDataFrame(notices, "doc_id long, text string")).collect()) == 2
    assert license_scan.scan(odd_documents).count() == 0
    assert license_scan.scan(odd_documents.limit(0)).count() == 0
    empty = spark.createDataFrame([("X", "two words"), ("Y", None)], "license string, template string")
    assert license_scan.scan(odd_documents, empty).count() == 0
    with pytest.raises(ValueError, match="bands"):
        license_scan.scan(odd_documents, bands=2, rows=4)
    long = spark.createDataFrame([("X", "a " * 1000)], "license string, template string")
    with pytest.raises(ValueError, match="templates"):
        license_scan.scan(odd_documents, long)
    assert license_scan.band_chance(0.75) > 0.99


def test_bands_are_sure_for_the_threshold(spark):
    """Bands meet by Jaccard similarity: a window that holds 3/4 of the template has 0.6, one that holds half 1/3."""
    assert license_scan.band_chance(license_scan.least_similarity(0.75, 4, 4)) > 0.999
    for contained, bands in [(0.5, 17), (0.75, 8)]:
        assert license_scan.band_chance(contained, bands, 2) > 0.99
        with pytest.raises(ValueError, match="bands"):
            license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None, contained, bands)
    repeated = spark.createDataFrame([("X", "a " * 100)], "license string, template string")
    with pytest.raises(ValueError, match="template of X"):
        license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), repeated)


def test_every_edit_of_a_notice_is_found(spark):
    """Any neighbouring words of a notice replaced, at every place, as long as enough of it is left."""
    texts = []
    for template in TEMPLATES.values():
        words = tokens(template)
        for n in (1, 2, 3, 4):
            for at in range(len(words) - n + 1):
                edited = words[:at] + [f"new{k}" for k in range(n)] + words[at + n :]
                texts.append((len(texts), "some words before " + " ".join(edited) + " and some words after"))
    assert rows(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)


def test_plan_has_no_python(spark, documents):
    plan = license_scan.scan(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
