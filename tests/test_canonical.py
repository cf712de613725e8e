import json
import random
import struct

from pyspark.sql import functions as F

from tallyreel.functions import canonical


def dumps(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def test_numbers_are_written_as_plain_python_writes_them(spark):
    chance = random.Random(8)
    numbers = [0.0, -0.0, 1.0, -1.5, 1e16, 9999999999999998.0, 1e15, 1e-4, 1e-5, 123456.789, 1e7, 2e-3, 2.0**-44]
    numbers += [1e22, 1e23, 2e23, 5e-324, 1.7976931348623157e308, 0.1 + 0.2, 100 / 3, float("nan"), float("-inf")]
    numbers += [round(chance.uniform(-1e6, 1e6), chance.randrange(10)) for _ in range(2000)]
    numbers += [struct.unpack("d", chance.randbytes(8))[0] for _ in range(3000)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select("n", canonical.number(F.col("n")).alias("t"))
    assert [r["t"] for r in rows.collect()] == [dumps(n) for n in numbers]


def test_nested_values_are_written_as_plain_python_writes_them(spark):
    kind = (
        "s string, m map<string, struct<z: double, a: array<string>>>, h map<int, double>, b boolean, "
        "l array<struct<y: bigint, x: string>>, o struct<q: string, `a b`: int>"
    )
    controls = "".join(map(chr, range(128))) + "\\u001F é  😀 \\n"
    rows = [
        (controls, {"b": (1.0, ["x", None]), "a\n": None, "é": (None, [])}, {10: 1e16, 9: None, 2: 0.5}, True,
         [(1, "u"), None, (None, None)], ("v", None)),
        ("", {}, {}, False, [], None),
        (None, None, None, None, None, (None, 7)),
    ]
    frame = spark.createDataFrame(rows, kind)
    texts = frame.select(canonical.json(F.struct(*frame.columns), frame.schema).alias("t")).collect()
    for row, text in zip(frame.collect(), texts, strict=True):
        assert text["t"] == dumps(row.asDict(recursive=True))
