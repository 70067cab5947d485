import struct

import numpy as np
import pytest
from conftest import dense, matrix, values

from matloom import SparseMatrix, Vector
from matloom.operators import structure
from matloom.sources import binary, binary_format, generators, sinks
from matloom.sources.matrix_market import read_matrix_market

SYMMETRIC = """%%MatrixMarket matrix coordinate real symmetric
% a comment
3 3 4
1 1 2.0
2 1 -1.0
3 2 -1.5
3 3 4
"""
# The entry line repeats the size line.
TWIN = "%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 5\n2 2 3\n1 2 7\n"
PATTERN = "%%MatrixMarket matrix coordinate pattern general\n2 4 2\n1 4\n2 1\n"


def read(spark, tmp_path, text, **kw):
    path = tmp_path / "m.mtx"
    path.write_text(text)
    return read_matrix_market(spark, str(path), **kw)


def test_matrix_market_kinds(spark, tmp_path):
    a = read(spark, tmp_path, SYMMETRIC)
    assert dense(a).tolist() == [[2, -1, 0], [-1, 0, -1.5], [0, -1.5, 4]]
    assert dense(read(spark, tmp_path, TWIN)).tolist() == [[5, 7], [0, 3]]
    assert dense(read(spark, tmp_path, PATTERN)).tolist() == [[0, 0, 0, 1], [1, 0, 0, 0]]


def test_matrix_market_duplicates(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 5\n1 1 6\n"
    assert dense(read(spark, tmp_path, text))[0, 0] == 11
    assert read(spark, tmp_path, text, duplicates="keep").df.count() == 2
    with pytest.raises(Exception, match="duplicate"):
        read(spark, tmp_path, text, duplicates="error").df.collect()


def test_matrix_market_round_trip(spark, tmp_path):
    a = matrix(spark, [[1, 0, 2.5], [0, 0, 0], [4, 0, 0]])
    sinks.write_matrix_market(a, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert dense(read(spark, tmp_path, text)).tolist() == dense(a).tolist()


def test_binary_files_in_ranges(spark, tmp_path):
    cells = [(i, (i * 7) % 10, i + 0.5) for i in range(10)]
    body = b"".join(struct.pack("<dii", v, j, i) for i, j, v in cells)
    (tmp_path / "m.bin").write_bytes(struct.pack("<q", 10) + body)
    a = binary.read_coo(spark, str(tmp_path / "m.bin"), chunk=3)
    assert sorted(tuple(r) for r in a.df.collect()) == sorted(cells)
    assert (a.nrows, a.ncols) == (10, 10)
    (tmp_path / "v.bin").write_bytes(struct.pack("<q4d", 4, 1, 2, 3, 4))
    assert values(binary.read_vector(spark, str(tmp_path / "v.bin"), chunk=3)) == [1, 2, 3, 4]


def test_parquet_keeps_shape_and_structure(spark, tmp_path):
    a = structure.to_symmetric(matrix(spark, [[1, 2, 0], [2, 0, 0], [0, 0, 0]]))
    sinks.write_matrix(a, str(tmp_path / "m"))
    b = sinks.read_matrix(spark, str(tmp_path / "m"))
    assert (b.nrows, b.ncols, b.structure) == (3, 3, "sym_upper")
    assert sorted(map(tuple, b.df.collect())) == sorted(map(tuple, a.df.collect()))


def test_svg_is_one_document_in_order(spark, tmp_path):
    sinks.write_svg(matrix(spark, [[1, 0], [0, 1]]), str(tmp_path / "s"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text.startswith("<svg") and text.rstrip().endswith("</svg>") and text.count("<rect") == 2


def test_generators_do_not_depend_on_partitions(spark):
    rows = spark.range(40).withColumnRenamed("id", "i")
    one = generators.random_pattern(rows.repartition(1), 40, 5, seed=1).df.collect()
    many = generators.random_pattern(rows.repartition(7), 40, 5, seed=1).df.collect()
    assert sorted(one) == sorted(many)
    per_row = {}
    for r in one:
        per_row.setdefault(r["i"], set()).add(r["j"])
    assert all(len(c) == 5 for c in per_row.values()) and len(per_row) == 40
    assert generators.sample_ordered(spark.range(50), 9, seed=2).distinct().count() == 9


def test_row_pointer_from_base_one(spark, ws):
    a = matrix(spark, [[1, 0, 1], [0, 0, 0], [1, 1, 1]])
    ptr, body = sinks.compressed_rows(ws, a, base=1)
    assert [r["ptr"] for r in ptr.orderBy("i").collect()] == [1, 3, 3, 6]
    assert np.array([r["j"] for r in body.collect()]).tolist() == [1, 3, 1, 2, 3]


def test_binary_sources_round_trip(spark, tmp_path):
    a = matrix(spark, [[1, 0, 2.5], [0, 0, 0], [4, 0, -1]])
    for base, order in ((0, "v,j,i"), (1, "i,j,v")):
        path = str(tmp_path / f"m{base}")
        binary_format.write_coo(a, path, base, order)
        assert not [p for p in (tmp_path / f"m{base}").iterdir() if p.name.startswith("_")]
        want = sorted(tuple(r) for r in a.df.collect())
        assert sorted(tuple(r) for r in binary_format.load_coo(spark, path, base, order, chunk=1).collect()) == want
    x = spark.range(1000).selectExpr("id AS i", "id * 0.5D AS v")
    binary_format.write_vector(Vector(x, 1000), str(tmp_path / "x"))
    got = binary_format.load_vector(spark, str(tmp_path / "x"), chunk=77).collect()
    assert sorted(tuple(r) for r in got) == [(k, 0.5 * k) for k in range(1000)]


def test_binary_sources_read_single_files_with_a_header(spark, tmp_path):
    cells = [(i, (i * 7) % 10, i + 0.5) for i in range(10)]
    (tmp_path / "m.bin").write_bytes(struct.pack("<q", 10) + b"".join(struct.pack("<dii", v, j + 1, i + 1) for i, j, v in cells))
    path = str(tmp_path / "m.bin")
    assert sorted(tuple(r) for r in binary_format.load_coo(spark, path, base=1, chunk=3).collect()) == sorted(cells)
    assert sorted(tuple(r) for r in binary.read_coo(spark, path, base=1, chunk=3).df.collect()) == sorted(cells)
    (tmp_path / "v.bin").write_bytes(struct.pack("<q4d", 4, 1, 2, 3, 4))
    assert [r["v"] for r in binary_format.load_vector(spark, str(tmp_path / "v.bin")).orderBy("i").collect()] == [1, 2, 3, 4]


def test_binary_writer_refuses_what_does_not_fit(spark, tmp_path):
    far = spark.createDataFrame([(2**31, 0, 1.0)], "i long, j long, v double")
    with pytest.raises(Exception, match="beyond 32 bits"):
        binary_format.write_coo(SparseMatrix(far, 2**31 + 1, 1), str(tmp_path / "far"))
    assert binary_format.load_coo(spark, str(tmp_path / "far")).count() == 0
    gaps = spark.createDataFrame([(0, 1.0), (2, 1.0)], "i long, v double").coalesce(1)
    with pytest.raises(Exception, match="consecutive"):
        gaps.write.format("binary_vector").mode("append").save(str(tmp_path / "gaps"))
    with pytest.raises(Exception, match="order"):
        binary_format.load_coo(spark, str(tmp_path / "far"), order="i,i,v").count()
