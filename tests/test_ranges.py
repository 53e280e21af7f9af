"""Files read by ranges against files read whole, with ranges of a few bytes."""

import json
import random

import pytest

from seqweave.sources import corpora, ranges


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.offset, tuple(r.symbols)) for r in df.collect())


def hard_symbols(rng):
    return ["".join(rng.choice(['A', '"', "\\", "[", "]", "{", "}", "é", "字", " ", ",", ":", "\n"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 4))]


def hard_files(folder):
    rng = random.Random(7)
    lists = [hard_symbols(rng) for _ in range(40)]
    objects = [{"id": i, "note": {"deep": [["x"]]}, ["signs", "sequence", "tokens"][i % 3]: hard_symbols(rng)} for i in range(40)]
    files = {
        "a": lists, "b": objects, "c": {"meta": {"texts": [["no"]]}, "note": '"data": [', "data": lists, "texts": [["other"]]}, "d": {"texts": [["no"]], "inscriptions": objects},
        "e": ["X", "Y [", "\\"], "f": {"texts": ["P", "Q"]}, "g": [], "h": {"other": [["no"]]}, "i": [["A"], "skipped", {"none": 1}, None, 3, ["B", "C"]],
    }
    for k, v in files.items():
        (folder / f"{k}.json").write_text(json.dumps(v, ensure_ascii=k in "ac", indent=1 if k in "bc" else None), encoding="utf-8")
    (folder / "j.json").write_text("")
    (folder / "k.json").write_text(" \n [[\"A\", \"B\"], [\"C\"")
    symbols = lambda x: tuple(x if isinstance(x, list) else next(x[k] for k in ("signs", "sequence", "tokens") if k in x))
    want = {"a": lists, "b": objects, "c": lists, "d": objects, "e": [files["e"]], "f": [["P", "Q"]], "i": [["A"], ["B", "C"]], "k": [["A", "B"]]}
    return sorted((f"{k}.json", symbols(x)) for k, v in want.items() for x in v)


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_json_lists_by_ranges(spark, tmp_path, split):
    want = hard_files(tmp_path)
    got = rows(ranges.read_json_lists(spark, str(tmp_path), split))
    assert sorted((f, s) for f, _, s in got) == want
    assert len({(f, o) for f, o, _ in got}) == len(got)


def test_ids_do_not_follow_splits(spark, tmp_path):
    hard_files(tmp_path)
    ids = [sorted((r.seq_id, tuple(r.symbols)) for r in ranges.read_json_lists(spark, str(tmp_path / "d.json"), split).collect()) for split in (50, 333)]
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == 40
    whole = sorted(tuple(r.symbols) for r in corpora.read_json(spark, str(tmp_path / "d.json")).collect())
    assert sorted(s for _, s in ids[0]) == whole


@pytest.mark.parametrize("split", [3, 40, 1 << 20])
def test_lines_by_ranges(spark, tmp_path, split):
    text = "a b #c\n\nd\r\n@x é 字 f\n" + "g " * 50 + "\nlast line"
    (tmp_path / "t.txt").write_bytes(text.encode())
    (tmp_path / "u.txt").write_bytes(b"\n\nx y\n")
    got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in ranges.read_text_lines(spark, str(tmp_path), split).collect())
    want = []
    for name in ("t.txt", "u.txt"):
        at = 0
        for line in (tmp_path / name).read_bytes().splitlines(keepends=True):
            want.append((name, at, line.decode().rstrip("\r\n")))
            at += len(line)
    assert got == want
    seqs = ranges.read_transliteration(spark, str(tmp_path), split=split)
    assert sorted(tuple(r.symbols) for r in seqs.collect()) == sorted([("a", "b"), ("é", "字", "f"), ("g",) * 50, ("last", "line"), ("x", "y")])


def test_a_file_goes_to_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([[str(i), "x"] for i in range(20000)]))
    assert ranges.ranges(spark, str(tmp_path / "big.json"), 32768).rdd.getNumPartitions() > 8
    got = ranges.read_json_lists(spark, str(tmp_path / "big.json"), 32768)
    assert sorted(int(r.symbols[0]) for r in got.collect()) == list(range(20000))
