"""Records of quoted text, cut at every place that Spark may split a file."""

import csv
import io
import random

import pytest
from factdrift.sources.quoted import quoted_records
from pyspark.sql import functions as F


def split_lines(spark, files, size):
    """Lines as Spark reads them when a part begins at every ``size`` bytes."""
    rows = []
    for name, text in files.items():
        at = 0
        lines = text.split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        for k, line in enumerate(lines):
            rows.append((name, at // size * size, k, line))
            at += len(line.encode()) + 1
    return spark.createDataFrame(rows, "file string, start long, row long, value string").repartition(5)


def plain_records(text):
    out, state, record = [], False, []
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        record.append(line)
        at, start = 0, not state
        while at < len(line):
            if state:
                end = line.find('"', at)
                if end < 0:
                    break
                if line[end : end + 2] == '""':
                    at = end + 2
                    continue
                state, start, at = False, False, end + 1
            elif start and line[at] == '"':
                state, at = True, at + 1
            else:
                start, at = line[at] == ",", at + 1
        if not state:
            out.append("\n".join(record))
            record = []
    return out + (["\n".join(record)] if record else [])


@pytest.mark.parametrize("size", [1, 7, 40, 100_000])
def test_records_however_a_file_is_split(spark, size):
    rng = random.Random(size)
    cells = ["", "a", 'say "x"', "two\nlines", '"', '""', "a,b", "\n", "\n\n,\n", '"\n"', "0.5", "x\ny\nz"]
    files = {}
    for name in "abc":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(40):
            writer.writerow([rng.choice(cells) for _ in range(rng.randint(1, 4))])
        files[name] = out.getvalue()
    files["stray"] = 'a"b,"c\nd"x,e"f\n"g"h"i,"\n",j\nplain\n"never closed\nx\n'
    files["one"] = "a,b\n"
    found = quoted_records(split_lines(spark, files, size)).groupBy("file").agg(F.sort_array(F.collect_list("value")).alias("v"))
    got = {r.file: r.v for r in found.collect()}
    assert got == {name: sorted(plain_records(text)) for name, text in files.items()}
    for name in "abc":
        assert sorted(next(csv.reader([r], strict=False), []) if "\n" not in r else next(csv.reader(io.StringIO(r))) for r in got[name]) == sorted(
            csv.reader(io.StringIO(files[name]))
        )
