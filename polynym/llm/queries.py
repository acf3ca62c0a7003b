"""Queries over the numbered operators, with production parameters and whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from polynym.llm import epsilon_grid, exact_dedup, fuzzy_lines, merkle, mixing, prefix_free, quality_crf, sentencepiece_spans, simhash, token_counts, transport_stream, warc, whitening
from polynym.operators.materialize import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _token_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of encoded and decoded batches; spans_sha256 is over the starts and ends as 32-bit numbers."""
    number: list[bytes] = []
    for b in batches:
        columns = [b.column(n) for n in ("ids", "starts", "ends")]
        flat = [c.flatten().to_numpy() for c in columns]
        offset = columns[0].offsets.to_numpy()
        cut = list(zip((offset[:-1] - offset[0]).tolist(), (offset[1:] - offset[0]).tolist(), strict=True))
        if len(flat[0]) and (most := int(flat[0].max())) >= len(number):
            number += [str(i).encode() for i in range(len(number), most + 1)]
        ids = [hashlib.sha256(b" ".join(map(number.__getitem__, flat[0][i:j].tolist()))).hexdigest() for i, j in cut]
        spans = [hashlib.sha256(flat[1][i:j].tobytes() + flat[2][i:j].tobytes()).hexdigest() for i, j in cut]
        decoded = [hashlib.sha256(t.as_py() or b"").hexdigest() for t in b.column("decoded").cast(pa.binary())]
        out = [b.column("doc_id"), pa.array([j - i for i, j in cut], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


def op1_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, decoding and digests follow each other in one task, so ids and spans never leave it."""
    model = sentencepiece_spans.read_model(_model("piece_bpe_32k.model"))
    encode, decode = sentencepiece_spans.encode_batches(model, add_eos=True), sentencepiece_spans.decode_batches(model)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(lambda b: _token_digests(decode(encode(b))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_digests(_table(spark, sf_dir, "documents"))


def op3_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.removal_digests(_table(spark, sf_dir, "documents"), length=100)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, max_diff=4)


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, sample=2000)


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"), _model("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.with_percentiles(token_counts.suffix_sums(materialize(token_counts.histogram(lengths), "lengths")))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_archives(_table(spark, sf_dir, "pages"), least=100).drop("file")


#: Target weights of the mixture; sources not named weigh 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"), WEIGHTS, default_weight=1.0, epochs=1.0, seed=42)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(_table(spark, sf_dir, "documents"), blocks=8, similarity=0.8)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"), most=8)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = (op1_sentencepiece_spans, op2_transport_stream, op3_prefix_free, op4_simhash_near_dedup, op5_epsilon_grid, op6_token_counts, op7_warc_revisits, op8_poisson_mix, op9_fuzzy_lines, op10_quality_crf, op11_exact_dedup, op12_whitening, op13_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_epsilon_grid": epsilon_grid.oracle(0.98),
        "op7_warc_revisits": warc.oracle(100),
        "op8_poisson_mix": mixing.oracle(WEIGHTS, 1.0, 1.0, 42, "doc_id, text, lang, source, n_chars"),
        "op11_exact_dedup": exact_dedup.oracle(),
        "op13_merkle_manifest": merkle.oracle(),
    }
