"""Deduplication against brute force, brand casing, publishing and indexes."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from merchlens.operators import catalog as cat
from merchlens.operators import lexical as lx
from merchlens import session
from merchlens.sources import readers, sinks, upserts

SCHEMA = (
    "uniq_id string, product_name string, brand string, category string, discounted_price double, description string, "
    "product_specifications_parsed array<struct<key:string,value:string>>"
)


def greedy(rows):
    clusters = {}
    for r in rows:
        clusters.setdefault((r[1].lower(), (r[2] or "").lower(), r[3], r[4]), []).append(r)
    kept = set()
    for members in clusters.values():
        specs = {r[0]: {k.lower(): v.lower() for k, v in r[6]} for r in members}
        chosen = []
        for r in sorted(members, key=lambda r: (-len(r[5] or ""), -len(specs[r[0]]), r[0])):
            mine = specs[r[0]]
            if all(any(mine[k] != specs[c][k] for k in mine.keys() & specs[c].keys()) for c in chosen):
                chosen.append(r[0])
        kept.update(chosen)
    return kept


def random_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        specs = [(k, rnd.choice("xyz")) for k in ("Color", "Size", "Model") if rnd.random() < 0.6]
        rows.append((f"id{i:04d}", "Lamp", rnd.choice(["A", "a", None]), "Home", rnd.choice([1.0, 2.0]), "d" * rnd.randint(0, 3), specs))
    return rows


@pytest.mark.parametrize("fold_limit", [2000, 3])
def test_dedup_matches_brute_force(spark, fold_limit):
    rows = random_rows(150, 5)
    got = {r.id for r in cat.dedup_keys(spark.createDataFrame(rows, SCHEMA), fold_limit=fold_limit).collect()}
    assert got == greedy(rows)


def test_large_clusters_take_few_rounds(spark, monkeypatch):
    rounds = []
    store = cat.cut_lineage
    monkeypatch.setattr(cat, "cut_lineage", lambda df: rounds.append(1) or store(df))
    # 50,000 rows of one product that all conflict: every one is kept.
    conflicting = [(f"id{i:05}", "Lamp", "A", "Home", 1.0, "d" * (i % 5), [("Model", f"m{i}"), ("Color", "x")]) for i in range(50_000)]
    got = cat.dedup_keys(spark.createDataFrame(conflicting, SCHEMA)).collect()
    assert {r.id for r in got} == {r[0] for r in conflicting} and len(rounds) < 20
    # Rows without specs agree with all others; few keys make most rows agree with some.
    rounds.clear()
    rnd = random.Random(12)
    mixed = []
    for i in range(3000):
        specs = [(k, rnd.choice("abcdefgh")) for k in ("Color", "Size", "Model", "Finish") if rnd.random() < 0.8]
        mixed.append((f"id{i:05}", "Lamp", "A", "Home", 1.0, "d" * rnd.randint(0, 9), specs))
    got = cat.dedup_keys(spark.createDataFrame(mixed, SCHEMA), fold_limit=10).collect()
    assert {r.id for r in got} == greedy(mixed) and len(rounds) < 40  # two tables a round


def test_dedup_does_not_depend_on_row_order(spark):
    rows = random_rows(80, 9)
    a = {r.id for r in cat.dedup_keys(spark.createDataFrame(rows, SCHEMA)).collect()}
    b = {r.id for r in cat.dedup_keys(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()}
    assert a == b


def test_brand_canonical(spark):
    brands = ["D-Link", "d-link", "D-LINK", "D-LINK", "D-Link", "Sony", "sony", "none", None]
    got = {r.brand_key: r.canonical for r in cat.brand_canonical(spark.createDataFrame([(b,) for b in brands], "brand string")).collect()}
    assert got == {"d-link": "D-Link", "sony": "Sony"}


def test_clean_catalog_end_to_end(spark, tmp_path):
    head = [f.name for f in readers.RAW_CATALOG]
    rows = [
        ["u1", "t", "http://x", "A <b>mug</b>", '["Kitchen >> Mugs"]', "p1", "10", "8", "[]", "f", "long text here", "4.5", "", "acme", '{"product_specification"=>[{"key"=>"Color", "value"=>"red"}]}'],
        ["u2", "t", "http://x", "a mug", '["Kitchen >> Mugs"]', "p1", "10", "8", "[]", "f", "short", "x", "3", "Acme", '{"product_specification"=>[{"key"=>"Color", "value"=>"red"}]}'],
        ["u3", "t", "http://x", "a mug", '["Kitchen >> Mugs"]', "p1", "10", "0", "[]", "f", "short", "x", "3", "Acme", "nil"],
    ]
    path = tmp_path / "raw.csv"
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    path.write_text("﻿" + "\n".join(",".join(map(quote, r)) for r in [head, *rows]), encoding="utf-8")
    raw = readers.read_csv(spark, str(path), multi_line=True)
    chosen = cat.select_candidates(raw, ["Kitchen"])
    clean = cat.clean_catalog(chosen).collect()
    assert [(r.product_id, r.product_name, r.brand, r.rating) for r in clean] == [("u1", "A mug", "Acme", 4.5)]
    assert cat.removal_counts(chosen).first().invalid_price == 1


def test_publish_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "product_id string, retrieval_text string")
    out = sinks.publish(df, str(tmp_path / "kb"))
    assert out.count() == 2
    with pytest.raises(readers.ContractError):
        sinks.publish(df, str(tmp_path / "kb"))
    with pytest.raises(readers.ContractError):
        sinks.publish(df.union(df), str(tmp_path / "dup"))
    assert readers.read_catalog(spark, str(tmp_path / "kb"), ["product_id"]).columns == ["product_id"]
    sinks.write_new(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    with pytest.raises(Exception):
        sinks.write_new(df, str(tmp_path / "j"))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"product_id": "a"}\n[1]\n')
    with pytest.raises(readers.ContractError):
        readers.read_jsonl(spark, str(bad), df.schema)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red mug"), (2, "red cup"), (3, "blue cup")], "id bigint, text string")
    index = lx.fit(docs, "id", "text", max_df=1.0)
    path = str(tmp_path / "ix")
    sinks.save_index(index.postings, index.vocab, index.corpus_size, path)
    back = sinks.load_tables(spark, path, verify=True)
    assert sorted(map(tuple, back["postings"].collect())) == sorted(map(tuple, index.postings.collect()))
    assert back["vocab"].count() == 2 and back["size"].first().n_docs == 3
    with pytest.raises(readers.ContractError):
        sinks.save_index(index.postings, index.vocab, index.corpus_size, path)
    index.postings.write.mode("append").parquet(f"{path}/postings")
    with pytest.raises(readers.ContractError):
        sinks.load_tables(spark, path)


def test_stored_artifact_follows_its_inputs(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        sinks.save_tables({"n": spark.read.parquet(f"{tmp_path}/docs.parquet").selectExpr("count(*) AS n")}, path)

    def stored():
        return sinks.stored(spark, str(tmp_path), "count", ["docs"], make)["n"].first().n

    spark.range(3).write.parquet(f"{tmp_path}/docs.parquet")
    assert stored() == stored() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/docs.parquet")
    assert stored() == 5 and len(made) == 2


def test_load_needs_an_empty_target(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1), ("b", 2)], "product_id string, x int")
    with pytest.raises(readers.ContractError):
        sinks.load_empty(rows.union(rows), path, "product_id")
    assert not (tmp_path / "t").exists()
    assert sinks.load_empty(rows.limit(0), path, "product_id").count() == 0
    assert sinks.load_empty(rows, path, "product_id").count() == 2
    with pytest.raises(readers.ContractError):
        sinks.load_empty(rows, path, "product_id")


def test_failed_load_leaves_the_target(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1), ("b", 2)], "product_id string, x int")
    assert sinks.load_empty(rows.limit(0), path, "product_id").count() == 0
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    with pytest.raises(readers.ContractError):
        sinks.load_empty(rows.union(rows), path, "product_id")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before
    rows.write.parquet(f"{tmp_path}/staging")
    with pytest.raises(readers.ContractError):
        sinks.promote(spark, f"{tmp_path}/staging", path)


def test_changes_rewrite_only_the_folders_they_lie_in(spark, tmp_path):
    path, fields = str(tmp_path / "t"), ["name", "price"]
    t0, t1 = (F.lit(f"2024-0{m}-01").cast("timestamp") for m in (1, 2))
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 7 == 0 else float(i)) for i in range(5000)], "id long, name string, price double")
    upserts.create_table(rows, path, "id", fields, t0, buckets=20)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    same = {r.action: r.rows for r in upserts.apply_changes(spark, path, rows, fields, t1).collect()}
    assert same == {"UNCHANGED": 5000, "KEPT": 0} and files() == before
    bucket = lambda df: {r[0] for r in df.select(F.pmod(F.xxhash64("id"), F.lit(20))).distinct().collect()}
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(20)).isin(3, 4)).limit(50).withColumn("price", F.lit(None).cast("double"))
    new = spark.createDataFrame([(900_000, "new", 1.0)], rows.schema)
    incoming = some.unionByName(new)
    got = {r.action: r.rows for r in upserts.apply_changes(spark, path, incoming, fields, t1).collect()}
    changed = some.join(rows.filter("price is not null"), "id", "left_semi").count()
    assert got == {"INSERTED": 1, "UPDATED": changed, "UNCHANGED": 50 - changed, "KEPT": 4950}
    touched = {f"bucket={b}" for b in bucket(incoming)}
    after = files()
    assert {f: t for f, t in after.items() if f.split("/")[0] not in touched} == {f: t for f, t in before.items() if f.split("/")[0] not in touched}
    table = upserts.read_table(spark, path)
    assert table.count() == 5001 and table.filter(F.col("updated_at") == t1).count() == changed + 1
    assert table.filter(F.col("created_at") == t1).count() == 1
    with pytest.raises(readers.ContractError):
        upserts.apply_changes(spark, path, incoming.unionByName(incoming), fields, t1)


def test_publish_checks_the_target_first(spark, tmp_path):
    good = spark.createDataFrame([("a", "x")], "product_id string, retrieval_text string")
    assert sinks.publish(good, str(tmp_path / "p")).count() == 1
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(readers.ContractError):
        sinks.publish(good, str(tmp_path / "p"))
    assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_knowledge_base_refuses_what_does_not_match(spark):
    products = spark.createDataFrame([("a", "x"), ("b", "y")], "product_id string, product_name string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [0.0])], "product_id string, embedding array<double>")
    columns = ("product_id", "product_name", "embedding", "embedding_model")
    assert sinks.assemble_knowledge_base(products, vectors, "m", columns).count() == 2
    for bad in (vectors.limit(1), vectors.union(vectors), vectors.union(spark.createDataFrame([("c", [1.0])], vectors.schema))):
        with pytest.raises(readers.ContractError):
            sinks.assemble_knowledge_base(products, bad, "m", columns)
    with pytest.raises(readers.ContractError):
        sinks.assemble_knowledge_base(products, vectors, "m", (*columns, "category"))


def test_intermediates_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_the_package_can_be_shipped(spark):
    import zipfile

    names = zipfile.ZipFile(session.ship_package(spark)).namelist()
    assert "merchlens/operators/dense.py" in names and "merchlens/__init__.py" in names
