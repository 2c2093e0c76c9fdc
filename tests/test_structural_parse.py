"""split_records against a parser that goes through a record character by character."""

import random

import pytest

from arcweave.operators.structural_parse import IntCheck, KeyCheck, RecordSpec, rejects, relation_rows, relation_spec, split_records

SPEC = relation_spec("acct", "item")
A, B = "abcdEF12acct", "abcdEF12item"


def plain_parse(line):
    """(fields, None) or (None, reason)."""
    if line is None:
        return None, "columns"
    line = line.removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            text, i = "", i + 1
            while True:
                if i >= len(line):
                    return None, "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] != '"':
                        break
                    i += 1
                text += line[i]
                i += 1
            i += 1
            if i < len(line) and line[i] != ",":
                return None, "quoting"
            fields.append(text)
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return None, "quoting"
            fields.append(line[i:end] or None)
            i = end
        if i >= len(line):
            break
        i += 1
    if len(fields) != 6:
        return None, "columns"
    for name, field, suffix in (("from_key", fields[0], "acct"), ("to_key", fields[1], "item")):
        stem = (field or "")[:8]
        if len(field or "") != 12 or not field.endswith(suffix) or not (stem.isascii() and stem.isalnum()):
            return None, name
    ts = (fields[2] or "").strip(" ")
    digits = ts[1:] if ts[:1] in ("+", "-") else ts
    if not digits or any(c not in "0123456789" for c in digits) or not -(2**31) <= int(ts) < 2**31:
        return None, "ts"
    return fields, None


CASES = [
    None,
    "",
    "\r",
    ",",
    f"{A},{B},1,2,true,x",
    f"{A},{B},1,2,true,x\r",
    f"{A},{B},1,2,true,x\r\r",
    f'"{A}","{B}","1",2,true,"a,b"',
    f'{A},{B},1,2,true,"a ""b"" c"',
    f'{A},{B},1,2,true,"line\nbreak, comma"',
    f'{A},{B},1,2,true,""',
    f'{A},{B},1,2,true,""""',
    f'{A},{B},1,2,true,"""',
    f'{A},{B},1,2,true,"open',
    f'{A},{B},1,2,true,"x"y',
    f'{A},{B},1,2,true,x"y"',
    f'{A},{B},1,2, "true",x',
    f'{A},{B},1,2,"",""',
    f"{A},{B},1,2,true",
    f"{A},{B},1,2,true,x,y",
    f" {A},{B},1,2,true,x",
    f"{A} ,{B},1,2,true,x",
    f"abcdEF1éacct,{B},1,2,true,x",
    f"{A},{A},1,2,true,x",
    f",{B},1,2,true,x",
    *(f"{A},{B},{ts},2,true,x" for ts in ("", " ", "  12  ", "+5", "-5", "--5", "+", "1 2", "1.0", "1e3", "abc", "２", "2147483647", "2147483648", "-2147483648", "-2147483649", "0" * 40 + "7", "9" * 40, "\t1", "00", "-0")),
    f'{A},{B}," 12 ",2,true,x',
    f"{A},{B},1,,,",
    f"{A},{B},1," + "y" * 200_000 + ",true,x",
    '"' * 101,
    '"' * 100,
]


def check(spark, lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n long, text string")
    got = {r["n"]: r for r in split_records(df, "text", ["n"], SPEC).collect()}
    assert len(got) == len(lines)
    for i, line in enumerate(lines):
        fields, reason = plain_parse(line)
        assert got[i]["reason"] == reason, (line, got[i])
        assert [got[i][f"f{k}"] for k in range(6)] == (fields or [None] * 6), line


def test_cases(spark):
    check(spark, CASES)


def test_random_records(spark):
    rng = random.Random(3)
    parts = ['"', '""', ",", ",", "a", A, B, "12", " ", "\r", "\n", "é"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    lines += [",".join(rng.choice([A, B, f'"{A}"', "1", '"2"', "", '""', "x", '"a""b"', '"a"b']) for _ in range(rng.randint(5, 7))) for _ in range(3000)]
    check(spark, lines)


def test_rows_and_rejects(spark, rows):
    df = spark.createDataFrame([(1, f"{A},{B}, 7 ,2.5,YES,x"), (1, f"{A},{B}, 7 ,2.5,YES,x"), (2, "bad"), (3, f'{A},{B},7,n/a,,""')], "line_id long, line string")
    split = split_records(df, "line", ["line_id"], SPEC)
    assert rows(relation_rows(split, ["line_id"])) == [(1, A, B, 7, 2.5, True, "x")] * 2 + [(3, A, B, 7, None, None, "")]
    assert rows(rejects(split, ["line_id"])) == [(2, "columns", "bad")]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "id long, line string, reason string, f0 string, line_ string, REASON string")
    assert split_records(df, "line", ["id"], SPEC).count() == 0
    df = spark.createDataFrame([(1, f"{A},{B},1,,,", "old", "zero")], "id long, line string, reason string, f0 string")
    assert split_records(df, "line", ["id"], SPEC).first()["reason"] is None
    with pytest.raises(ValueError):
        split_records(df, "line", ["reason"], SPEC)


def test_files(spark, tmp_path, monkeypatch):
    from arcweave.operators import structural_parse

    texts = {
        "a": f'h1,h2\r\n{A},{B},1,2,true,"x\ny, ""z"""\r\n{A},{B},2,,,\n\n{A},{B},3,,,"two\n\nfeeds"',
        "b": f"h\n{A},{B},4,,,é\n",
        "c": "",
        "d": f'h\n{A},{B},5,,,"open\n{A},{B},6,,,\n',
        "e": "h",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    want = {
        "a": [f'{A},{B},1,2,true,"x\ny, ""z"""\r', f"{A},{B},2,,,", "", f'{A},{B},3,,,"two\n\nfeeds"'],
        "b": [f"{A},{B},4,,,é"],
        "d": [f'{A},{B},5,,,"open\n{A},{B},6,,,\n'],
    }
    got = {}
    df = structural_parse.read_records(spark, str(tmp_path / "*.csv"))
    for r in df.orderBy("file_name", "record_no").collect():
        got.setdefault(r.file_name[-5], []).append(r.line)
    assert got == want
    monkeypatch.setattr(structural_parse, "FILE_BLOCK", 5)  # a record that goes on behind its block is read on in such parts
    for block in (1, 2, 7, 50):
        again = {}
        for r in structural_parse.read_records(spark, str(tmp_path / "*.csv"), False, block).orderBy("file_name", "record_no").collect():
            again.setdefault(r.file_name[-5], []).append((r.record_no, r.line))
        assert {f: [x for n, x in rs if n > 0] for f, rs in again.items() if len(rs) > 1} == want
        assert again["e"] == [(0, "h")] and "c" not in again
        assert all([n for n, _ in rs] == list(range(len(rs))) for rs in again.values())
    reasons = {(r.file_name[-5], r.record_no): r.reason for r in split_records(df, "line", ["file_name", "record_no"], SPEC).collect()}
    assert reasons == {("a", 1): None, ("a", 2): None, ("a", 3): "columns", ("a", 4): None, ("b", 1): None, ("d", 1): "quoting"}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """One file, blocks of 1 kB: records with line feeds inside quotes over block bounds, against a plain pass over the text."""
    from pyspark.sql import functions as F

    from arcweave.operators.structural_parse import read_records

    rng = random.Random(11)
    made = ["head"] + [f'{i},"' + "".join(rng.choice(["x", "\n", '""', ",", "é"]) for _ in range(rng.randint(0, 60))) + '"' for i in range(3000)]
    (tmp_path / "big file.csv").write_bytes("\n".join(made).encode())
    df = read_records(spark, str(tmp_path / "big file.csv"), block_bytes=1000)
    assert [(r.record_no, r.line) for r in df.orderBy("record_no").collect()] == list(enumerate(made))[1:]
    parts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1500
    empty = tmp_path / "none"
    empty.mkdir()
    assert read_records(spark, str(empty)).count() == 0


def test_other_specs(spark):
    spec = RecordSpec(2, (KeyCheck("k", 0, "z", 1), IntCheck("n", 1, 64)))
    df = spark.createDataFrame([(0, "az,9223372036854775807"), (1, "az,9223372036854775808"), (2, "aaz,1"), (3, "az"), (4, "az,-9223372036854775808"), (5, "az,-9223372036854775809"), (6, "az,9999999999999999999")], "i int, t string")
    assert {r.i: r.reason for r in split_records(df, "t", ["i"], spec).collect()} == {0: None, 1: "n", 2: "k", 3: "columns", 4: None, 5: "n", 6: "n"}


def test_fields_that_may_be_absent(spark):
    spec = RecordSpec(4, (IntCheck("n", 1, 32),), least=2)
    lines = {"a,1": (None, ["a", "1", None, None]), "a,1,c,d,e,f": (None, ["a", "1", "c", "d"]), 'a,1,"x,y"': (None, ["a", "1", "x,y", None]), "a,1,,": (None, ["a", "1", None, None]), "a": ("columns", [None] * 4), "": ("columns", [None] * 4), "a,b": ("n", [None] * 4), 'a,1,"': ("quoting", [None] * 4), 'a,1,c,d,"e': ("quoting", [None] * 4)}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = {r.line: (r.reason, [r.f0, r.f1, r.f2, r.f3]) for r in split_records(df, "t", [], spec).collect()}
    assert got == lines
