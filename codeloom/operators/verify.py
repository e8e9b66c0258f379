"""Checking generated documentation: static findings, model reports, routing, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import norm_type

# --- fixed values: wording of findings and feedback ---------------------------
STATIC_TEXT = {
    "missing_parameter": "[Static] Parameter '%s' ada di kode tapi HILANG atau TIDAK DIBERIKAN pada dokumentasi.",
    "invented_parameter": "[Static] Parameter '%s' ada di dokumentasi tapi TIDAK ADA di kode (halusinasi).",
    "parameter_type": "[Static] Parameter '%s' memiliki type hint '%s' di kode, tapi didokumentasikan sebagai '%s'.",
    "return_type": "[Static] Fungsi memiliki return hint '%s' di kode, tapi didokumentasikan sebagai '%s'.",
    "missing_raise": "[Static] Kode terlihat me-raise '%s', tapi ini HILANG / TIDAK DIBERIKAN pada bagian 'raises' di dokumentasi.",
    "invented_raise": "[Static] Dokumentasi mencantumkan raises %s, tapi *error* ini tidak ditemukan di-*raise* secara eksplisit di dalam kode (Halusinasi).",
    "missing_yields": "[Static] Kode ini adalah generator (menggunakan 'yield'), tapi HILANG / TIDAK DIBERIKAN pada bagian 'yields' di dokumentasi.",
    "invented_yields": "[Static] Dokumentasi mencantumkan 'yields', tapi kode tersebut bukan generator, tidak ditemukan 'yield' statement secara eksplisit (Halusinasi).",
    "note": "[Static] (Info Penting) Pastikan penulisan WAJIB IDENTIK dan NYATA TERDAPAT PADA KODE yang sedang didokumentasikan.",
}
NO_DOCUMENT = "Documentation JSON tidak berhasil dibuat oleh Writer. Harap ulangi permintaan tugas Anda dengan tepat dan akurat."
MODEL_ERROR = "[LLM - ERROR]: Panggilan Verifier LLM gagal: %s"
SUGGESTION_HEAD = "**Saran Perbaikan dari Verifier (untuk %s):**"
FAILURE_LINES = [
    "**Saran Perbaikan dari Verifier :**",
    "-" * (40 + len("Writer")),
    "Saran Perbaikan (dari Sistem):",
    "Terjadi kesalahan internal saat Verifier AI mencoba mengevaluasi output JSON sebelumnya.",
    "Harap proses ulang permintaan tugas Anda. Perhatikan SEMUA aturan, konteks, dan kode komponend yang ingin didokumentasikan dengan saksama dan pastikan output JSON yang dihasilkan 100% akurat dan valid.",
]
STATIC_HEAD = "Kesalahan Faktual (Statis):"
READER_HEAD = "Saran Pencarian Konteks (dari Verifier Agent):"
WRITER_HEAD = "Saran Perbaikan Konten (dari Verifier Agent):"
# ----------------------------------------------------------------------------

CODES = list(STATIC_TEXT)


def _finding(df: DataFrame, code: str, subject: Column, *values: Column) -> DataFrame:
    text = STATIC_TEXT[code]
    line = F.format_string(text, *(values or (subject,))) if "%s" in text else F.lit(text)
    return df.select("repo_id", "id", F.lit(CODES.index(code)).alias("rank"), F.lit(code).alias("code"),
                     subject.alias("subject"), line.alias("text"))


def static_findings(docs: DataFrame, params: DataFrame, facts: DataFrame, raises: DataFrame) -> DataFrame:
    """Differences between code and documentation: (repo_id, id, rank, code, subject, text).

    ``docs(repo_id, id, doc)``; ``params``, ``facts`` and ``raises`` are keyed by
    component_id.  Leading stars of parameter names are ignored; ``self`` need
    not be documented but may not be invented.  Types are compared only where
    both sides state one.
    """
    key = ["repo_id", "id"]
    known = docs.where("doc IS NOT NULL")
    star = lambda c: F.regexp_replace(c, r"^\*+", "")
    written = known.select(*key, F.posexplode("doc.parameters").alias("at", "p")).select(
        *key, "at", F.col("p.name").alias("doc_name"), F.col("p.type").alias("doc_type"), star(F.col("p.name")).alias("name"))
    first = written.groupBy(*key, "name").agg(F.min(F.struct("at", "doc_name"))["doc_name"].alias("doc_name"))
    code = params.select("repo_id", F.col("component_id").alias("id"), star(F.col("name")).alias("name"),
                         F.col("annotation").alias("code_type"), F.lit(True).alias("_code")).distinct().join(known.select(*key), key, "left_semi")
    both = code.join(first, [*key, "name"], "full_outer")
    missing = both.where("doc_name IS NULL AND name <> 'self'")
    invented = both.where("_code IS NULL")
    code_type, doc_type = norm_type("code_type"), norm_type("doc_type")
    typed = written.join(code, [*key, "name"]).where((code_type != "") & (doc_type != "") & (code_type != doc_type))

    flags = facts.select("repo_id", F.col("component_id").alias("id"), "return_annotation", "has_yield")
    whole = known.select(*key, F.get("doc.returns", F.lit(0))["type"].alias("doc_return"),
                         F.coalesce(F.size("doc.yields") > 0, F.lit(False)).alias("doc_yields")).join(flags, key)
    c_ret, d_ret = norm_type("return_annotation"), norm_type("doc_return")
    returns = whole.where((c_ret != "") & (d_ret != "") & (c_ret != d_ret))

    doc_raises = known.select(*key, F.explode("doc.raises").alias("r")).select(*key, F.col("r.error").alias("error")).distinct()
    code_raises = raises.select("repo_id", F.col("component_id").alias("id"), F.col("name").alias("error")).distinct().join(known.select(*key), key, "left_semi")

    found = (
        _finding(missing, "missing_parameter", F.col("name"))
        .unionByName(_finding(invented, "invented_parameter", F.col("doc_name")))
        .unionByName(_finding(typed, "parameter_type", F.col("doc_name"), F.col("doc_name"), F.col("code_type"), F.col("doc_type")))
        .unionByName(_finding(returns, "return_type", F.lit("return"), F.col("return_annotation"), F.col("doc_return")))
        .unionByName(_finding(code_raises.join(doc_raises, [*key, "error"], "left_anti"), "missing_raise", F.col("error")))
        .unionByName(_finding(doc_raises.join(code_raises, [*key, "error"], "left_anti"), "invented_raise", F.col("error")))
        .unionByName(_finding(whole.where("has_yield AND NOT doc_yields"), "missing_yields", F.lit("yields")))
        .unionByName(_finding(whole.where("doc_yields AND NOT has_yield"), "invented_yields", F.lit("yields")))
    )
    return found.unionByName(_finding(found.select(*key).distinct(), "note", F.lit("")))


def merge_findings(docs: DataFrame, static: DataFrame, reports: DataFrame) -> DataFrame:
    """One verdict per component: findings, needs_revision, step, suggestion, model_ok.

    ``docs(repo_id, id, doc)`` lists every component that was written (doc null
    if writing failed); ``reports(repo_id, id, report, error)`` has a null report
    if the model failed.  Static findings always send the work back to the
    writer; otherwise the model's own next step counts.
    """
    key = ["repo_id", "id"]
    # the findings of one component are no more than the items of its own record and signature
    listed = static.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "subject", "text"))).alias("_s")).select(
        *key, F.transform("_s", lambda s: s["text"]).alias("_static"))
    joined = docs.select(*key, F.col("doc").isNotNull().alias("_doc")).join(listed, key, "left").join(reports, key, "left")
    none = F.array().cast("array<string>")
    fixed = F.coalesce("_static", none)
    failed = F.col("report").isNull()
    wrong = F.transform(F.filter("report.critiques", lambda c: ~F.coalesce(c["is_accurate"], F.lit(False))),
                        lambda c: F.concat(F.lit("[LLM - "), F.coalesce(c["section"], F.lit("")), F.lit("]: "), F.coalesce(c["critique"], F.lit(""))))
    asked = F.col("report.suggested_next_step")
    advice = F.coalesce("report.suggestion_feedback", F.lit(""))
    model = F.when(failed, F.array(F.format_string(MODEL_ERROR, F.coalesce("error", F.lit(""))))).otherwise(F.concat(
        F.coalesce(wrong, none), F.when(asked != "finished", F.array(F.concat(F.lit("[LLM - SARAN]: "), advice))).otherwise(none)))
    findings = F.when(F.col("_doc"), F.concat(fixed, model)).otherwise(F.array(F.lit(NO_DOCUMENT)))
    step = (
        F.when(~F.col("_doc"), "writer").when(F.size(findings) == 0, "finished")
        .when((F.size(fixed) > 0) | failed, "writer").otherwise(asked))
    return joined.select(
        *key, findings.alias("findings"), (F.size(findings) > 0).alias("needs_revision"), step.alias("step"),
        F.when(~F.col("_doc"), NO_DOCUMENT).when(failed, "").otherwise(advice).alias("suggestion"),
        (F.col("_doc") & ~failed).alias("model_ok"))


def feedback_text(findings: Column | str = "findings", step: Column | str = "step", suggestion: Column | str = "suggestion",
                  model_ok: Column | str = "model_ok") -> Column:
    """What the writer or reader is told next; empty when the work is finished."""
    f, s, adv, ok = (F.col(c) if isinstance(c, str) else c for c in (findings, step, suggestion, model_ok))
    static = F.filter(f, lambda line: line.startswith("[Static]"))
    agent = F.when(s == "reader", "Reader").otherwise("Writer")
    none = F.array().cast("array<string>")
    has_advice = ok & (adv != "")
    fixed = F.when(F.size(static) > 0, F.concat(
        F.array(F.lit(STATIC_HEAD)),
        F.transform(static, lambda line: F.concat(F.lit("- "), F.trim(F.replace(line, F.lit("[Static] "), F.lit(""))))),
        F.when(has_advice, F.array(F.lit(""))).otherwise(none))).otherwise(none)
    advice = F.when(has_advice, F.array(F.when(s == "reader", READER_HEAD).otherwise(WRITER_HEAD), adv)).otherwise(none)
    lines = F.concat(F.array(F.format_string(SUGGESTION_HEAD, agent), F.repeat(F.lit("-"), F.length(agent) + 40)), fixed, advice)
    broken = ~ok & (F.size(static) == 0) & (adv == "")
    return F.when(s == "finished", "").when(broken, "\n".join(FAILURE_LINES)).otherwise(
        F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))
