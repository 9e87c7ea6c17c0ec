from pageloom.llm.licenses import NOTICES, TEXTS, known_licenses, scan_licenses
from tests.llm.helpers import empty, frame


def test_variants(spark):
    zero = NOTICES["0BSD"][0]
    rows = [
        (1, "Text.\nReleased under the MIT License.\nmore"), (2, "released   UNDER the “MIT” Licence"), (3, zero), (4, "Copyright (c) 2020 Someone\n\n" + zero.upper()),
        (5, "intro\n\n" + zero.replace("\n\n", "\n").replace(" of ", "\nof ") + "\n\nend"), (6, None), (7, ""), (8, "..."), (9, "Released under the MIT License, mostly."),
        (10, "x\n1. Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0!"), (10, "x\n1. Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0!"),
        (None, "Licensed under the Apache License, v2 0"), (11, "word " * 50_000)]
    found = scan_licenses(frame(spark, rows), known_licenses(spark)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert list(by[1].licenses) == ["MIT"] and by[1].n_matches == 1 and list(by[1].whole_licenses) == []
    assert list(by[2].whole_licenses) == ["MIT"]
    assert list(by[3].whole_licenses) == ["0BSD"] == list(by[4].whole_licenses) and by[3].digest == by[4].digest
    assert "0BSD" in by[5].licenses and list(by[5].whole_licenses) == []
    assert all(by[i].n_matches == 0 for i in (6, 7, 8, 9, 11)) and by[6].digest is None
    assert by[10].n_matches == 2 and list(by[10].licenses) == ["CC-BY-NC-4.0"]
    assert list(by[None].whole_licenses) == ["Apache-2.0"]


def test_texts_of_several_paragraphs_inside_a_longer_file(spark):
    texts = {path.stem.split("~")[0]: path.read_text() for path in sorted(TEXTS.glob("*.txt")) if "~" not in path.stem} | {"0BSD": NOTICES["0BSD"][0]}
    names = sorted(texts)
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "Unlicense", "0BSD"} < set(names) and len(names) == 12
    rows = [(i, texts[name]) for i, name in enumerate(names)]
    rows += [(100 + i, f"before\n\nit\n\n\n{texts[name]}\n\nbehind\nit\n") for i, name in enumerate(names)]
    head, _, tail = texts["MIT"].partition("\n\n")
    rows += [(200, f"The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n{texts['MIT']}"), (201, f"{head}\n\nan insertion\n\n{tail}"), (202, f"x\n\n{tail}"),
             (203, f"{texts['MIT']}\n\n{texts['0BSD']}\n\n{texts['MIT']}"), (204, f"x\n\n{head}\n\n{texts['MIT']}"), (205, f"x\n\nMIT License\n\n{texts['MIT']}")]
    by = {r.doc_id: r for r in scan_licenses(frame(spark, rows), known_licenses(spark)).collect()}
    for i, name in enumerate(names):
        assert list(by[i].whole_licenses) == name.split(",") == list(by[100 + i].licenses), name
        assert list(by[100 + i].whole_licenses) == [] and by[i].n_matches == 1 == by[100 + i].n_matches
    assert list(by[200].whole_licenses) == ["MIT"]
    assert all(by[i].n_matches == 0 and list(by[i].licenses) == [] for i in (201, 202))
    assert list(by[203].licenses) == ["0BSD", "MIT"] and by[203].n_matches == 3
    assert list(by[204].licenses) == ["MIT"] == list(by[205].licenses) and by[204].n_matches == 1 == by[205].n_matches


def test_empty_tables(spark):
    none = spark.createDataFrame([], "license_id string, text string")
    assert [(r.n_matches, list(r.licenses)) for r in scan_licenses(frame(spark, [(1, "MIT")]), none).collect()] == [(0, [])]
    assert scan_licenses(empty(spark), known_licenses(spark)).collect() == []
