"""Queries of this subpackage: name -> function, and the SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from netloom.llm import byte_bpe, decontaminate, fill_in_middle, filter_audit, langid, licences, reputation, sentencepiece_wfst, simhash, token_rollups, tool_calls, toxicity
from netloom.llm.common import cut, held_out, table
from netloom.llm.quality import fit_bands, judge, measure

ORACLES: dict[str, str] = {}
#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_sentencepiece(spark, sf_dir, model_file="piece_bpe_32k.model"):
    """Every document's piece ids, and whether they decode to its text."""
    model = sentencepiece_wfst.read_model(f"{TOKENIZERS}/{model_file}")
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=False)


def op2_decontaminate(spark, sf_dir):
    """Every document's benchmark windows, exact and by proximity."""
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_langid(spark, sf_dir):
    """Every document's language and mixture, by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = langid.train(docs.where("NOT held_out"))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op4_tool_calls(spark, sf_dir):
    """Every conversation's calls with their results."""
    linked = tool_calls.link_messages(table(spark, sf_dir, "conversations"))
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op5_token_rollups(spark, sf_dir, vocabulary="byte_bpe_50k.tiktoken"):
    """Token totals by source, language and tokenizer version after inserts, revisions, deletes and a repeated batch."""
    from public_tokenizers import PATTERN

    ranks = token_rollups.read_ranks(f"{TOKENIZERS}/{vocabulary}")
    return token_rollups.roll_up_documents(table(spark, sf_dir, "documents"), ranks, PATTERN, vocabulary).totals()


def op6_licences(spark, sf_dir):
    """Every document's license phrases and notices."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_reputation(spark, sf_dir):
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return reputation.judge(pages).select("page_id", "host", "path", "rule", "verdict", "mean", "bound")


def op8_simhash(spark, sf_dir):
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "group_size")


def op9_toxicity(spark, sf_dir):
    """Every document's toxicity and offending sentences, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    model = toxicity.train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op10_quality(spark, sf_dir):
    """Every document's quality counts, compression verdict and whether it is kept."""
    measured = cut(measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    return judge(measured, fit_bands(measured))


def op11_byte_bpe(spark, sf_dir):
    """Every document's token ids and the text that they decode to, as digests."""
    vocabulary = byte_bpe.read_vocabulary(f"{TOKENIZERS}/byte_bpe_50k.json")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    decoded = byte_bpe.decode(coded, vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark, sf_dir):
    """What each filter removes from each source in every order of the five."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark, sf_dir):
    """Every document's fill-in-middle form, and digests of its output and of the text restored from it."""
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return fill_in_middle.restore(made).drop("output", "restored")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_decontaminate, op3_langid, op4_tool_calls, op5_token_rollups, op6_licences, op7_reputation, op8_simhash, op9_toxicity, op10_quality, op11_byte_bpe, op12_filter_audit, op13_fill_in_middle)}
ORACLES["op7_reputation"] = reputation.SQL
ORACLES |= {"op2_decontaminate": decontaminate.SQL, "op4_tool_calls": tool_calls.SQL, "op12_filter_audit": filter_audit.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
