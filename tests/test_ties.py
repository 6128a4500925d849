import pyarrow as pa
import pyarrow.parquet as pq

from helixframe.plans import queries


def test_first_of_equal_lines(spark, tmp_path):
    """Of equal line numbers the row that stands first in the files by name, though Spark reads larger files first."""
    rows = [(o, 1 + k // 40, 1000 * o + (k * 37) % 97, 10.0 + 30 * (k % 2)) for k in range(120) for o in range(5)]
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, part in (("a", rows[:60]), ("b", rows[60:])):
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*part, strict=True)), strict=True))), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = {(r.l_orderkey, r.line, r.l_partkey) for r in queries.QUERIES["first_qualifying"](spark, str(tmp_path)).collect()}
    want = {}
    for o, line, part, quantity in rows:
        if quantity >= 30 and (o not in want or line < want[o][0]):
            want[o] = (line, part)
    assert got == {(o, *x) for o, x in want.items()}
