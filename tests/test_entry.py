import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "factloom.llm" or name.startswith("factloom.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
if %d:
    sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), *sorted(set(e.oracle_sql()) - set(e.queries())))
"""


def counts(gone: bool) -> list[int]:
    out = subprocess.run([sys.executable, "-c", WITHOUT % gone], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    return list(map(int, out.stdout.split()))


def test_entry_without_the_text_operators():
    n, oracles = counts(True)
    assert n >= 140 and oracles >= 140


def test_nothing_else_imports_the_text_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "factloom")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"(?:import|from)\s+\S*\bllm\b", open(os.path.join(folder, f)).read()), f


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["nation", "name", "total"] and df.count() > 0


def test_queries_against_sql(spark, small):
    """A sample of each group here; all of them are compared by the driver."""
    import duckdb

    from factloom.catalog import ORACLE, QUERIES

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    groups: dict[str, list[str]] = {}
    for name in ORACLE:
        groups.setdefault(name.split("_")[0], []).append(name)
    for name in [n for g in groups.values() for n in g[:3]]:
        df = QUERIES[name](spark, small)
        r = db.execute(ORACLE[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns), name
        got = sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in x) for x in map(tuple, df.select(*names).collect())), key=str)
        want = sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in x) for x in r.fetchall()), key=str)
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want], name


def test_plans_push_filters_and_prune_columns(spark, small):
    from factloom.star import star_store

    plan = star_store(spark, small).query(["proj", ["sel", "OrderHasStatus", 2, "F"], [1, 2]])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan.replace("\n", "") or "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan and "Exchange" not in plan
