"""The operators' registered queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.llm.common import prepare
from playtrail.llm import capture_index, compression, embedding_dedup, language, merkle, mixing, packing, pieces, sharding, simhash, token_store, weak_labels, whitening


QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_mix_sources")
def op1(table):
    mixed, names = mixing.mix_sources(table("documents"))
    return mixed.select("doc_id", *[F.col(names[c]).alias(c) for c in ("size", "source_size", "target", "taken")], "source")


@query("op2_feistel_shards")
def op2(table):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = table("documents").select(
        "doc_id", (F.length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed, names = sharding.shard_rows(light, "doc_id", 40, ties=("text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(names["shard"]).alias("shard"),
        F.col(names["slot"]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(names["row_number"]).alias("row_number"),
    )


@query("op3_embedding_near_dedup")
def op3(table):
    return embedding_dedup.embedding_components(table("embeddings"))


@query("op4_simhash_near_dedup")
def op4(table):
    found = simhash.simhash_components(table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_compression_bands")
def op5(table):
    measured, names = compression.quality_measures(table("documents"))
    return measured.select("doc_id", *[F.col(n).alias(c) for c, n in names.items()])


@query("op6_capture_index")
def op6(table):
    return capture_index.archive_and_read_back(table("pages"))


@query("op7_string_kernel_language")
def op7(table):
    return language.identify(table("documents"))


@query("op8_weak_label_quality")
def op8(table):
    return weak_labels.classify(table("documents"))


@query("op9_addressable_tokens")
def op9(table):
    return token_store.read_tokens(token_store.write_tokens(table("documents")))


@query("op10_best_two_fit")
def op10(table):
    return packing.pack_documents(table("documents"))


@query("op11_piece_round_trip")
def op11(table):
    encoded, ids = pieces.encode_documents(table("documents"), keep=["doc_id"])
    back, text = pieces.decode_documents(encoded, ids)
    return back.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"),
    )


def merkle_sql(levels: int = 6) -> str:
    """The manifest in DuckDB's SQL, for sources of up to 16^levels documents and as many sources: a finished tree stays as it is."""
    bits = "lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END"
    zeros = "[0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, x: list_reduce(list_prepend(xor(a, x), {zeros}), {bits})), 4294967295::UBIGINT)"

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def row(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(small)} END AS other FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)",
        "s0 AS (SELECT source AS g, pos AS idx, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM placed)",
    ]

    def climb(tree: str, ways: str) -> None:
        """Levels of a tree, and the steps of each leaf's digest through them; ``ways`` has g, idx, folded, proof."""
        for i in range(1, levels + 1):
            parts.append(f"{tree}r{i} AS (SELECT g, idx // 16 AS idx, list(d ORDER BY idx) AS ds, any_value(n) AS n FROM {tree}{i - 1} GROUP BY ALL)")
            digest = "CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END"
            parts.append(f"{tree}{i} AS (SELECT g, idx, {digest} AS d, (n + 15) // 16 AS n FROM {tree}r{i})")
            slot, before = "w.idx % 16", f"{ways}{i - 1}"
            left, right = f"array_to_string(r.ds[1:{slot}], '')", f"array_to_string(r.ds[{slot} + 2:], '')"
            parts.append(
                f"{ways}{i} AS (SELECT w.* REPLACE (w.idx // 16 AS idx, w.proof || CASE WHEN r.n = 1 THEN '' ELSE {left} || {right} END AS proof,"
                f" CASE WHEN r.n = 1 THEN w.folded ELSE sha256({left} || w.folded || {right}) END AS folded)"
                f" FROM {before} w JOIN {tree}r{i} r ON w.g IS NOT DISTINCT FROM r.g AND w.idx // 16 = r.idx)"
            )

    parts.append("w0 AS (SELECT source AS g, pos AS idx, doc_id, leaf, coalesce(other, leaf) AS folded, '' AS proof FROM placed)")
    climb("s", "w")
    parts.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, d, count(*) OVER () AS n, g AS source FROM s{levels})")
    parts.append(f"v0 AS (SELECT t.g, t.idx, w.doc_id, w.leaf, t.d AS subroot, w.folded, w.proof FROM w{levels} w JOIN t0 t ON w.g IS NOT DISTINCT FROM t.source)")
    climb("t", "v")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM v{levels} CROSS JOIN t{levels}"""


@query("op12_merkle_manifest", merkle_sql())
def op12(table):
    docs = table("documents")
    capitals = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": capitals}, where=touched)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


@query("op13_embedding_whitening")
def op13(table):
    rows, model, error = whitening.whiten(table("embeddings"), "vec_id", "embedding")
    long = whitening.by_component(rows, model, error, "vec_id")
    # n times a row may be too far from the sums for a long where there are very many rows: null then, exact beside it.
    exact = F.col("deviation")
    return long.withColumns({"deviation": exact.try_cast("bigint"), "deviation_exact": exact})
