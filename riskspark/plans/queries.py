"""The registered Spark queries: one callable per operator group of SURVEY §2.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole given
tables; column names match the oracle SQL in ``riskspark.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.config import DEFAULT_CONFIG, INDICATORS
from riskspark.plans.analyze import assess, case_id, top_cases
from riskspark.sources.fixtures import FIXED_THRESHOLD, accounts, accounts_p, persisted, scored_p

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(scored_p(spark, sf_dir), "p", FIXED_THRESHOLD)


IND_COLS = [f"ind_{k}" for k, *_ in INDICATORS]


@register("accounts_fixture")
def q_accounts(spark, sf_dir):
    return accounts(spark, sf_dir)


@register("risk_assessment")
def q_risk_assessment(spark, sf_dir):
    return analysis(spark, sf_dir).select(
        "account_id", "risk_score", "risk_probability", "severity", "recommended_action",
        "occupation", "standing", *IND_COLS)


@register("typology_assignment")
def q_typology(spark, sf_dir):
    return analysis(spark, sf_dir).select(
        "account_id", "risk_score", "typology", "rule_confidence", "confidence",
        F.array_join("matched_indicators", "|").alias("matched"), "typology_description")


@register("indicator_records")
def q_indicator_records(spark, sf_dir):
    from riskspark.functions.scoring import indicator_array
    a = analysis(spark, sf_dir)
    return a.select("account_id", F.inline(indicator_array()))


@register("top_flagged_cases")
def q_top_flagged(spark, sf_dir):
    return top_cases(analysis(spark, sf_dir)).select(
        "account_id", case_id(F.col("account_id")).alias("case_id"),
        "risk_score", "severity", "typology", "confidence")


@register("severity_distribution")
def q_severity_distribution(spark, sf_dir):
    return analysis(spark, sf_dir).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.min("risk_score").alias("min_score"), F.max("risk_score").alias("max_score"))


# ---------------------------------------------------------------- cleaning / profiling
def accounts_as_text(spark, sf_dir) -> DataFrame:
    """``accounts`` with every column as text, as a CSV read (A1) would deliver it."""
    acc = accounts_p(spark, sf_dir)
    return acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])


_MODELS: dict = {}


def cleaning(spark, sf_dir):
    """Fit the cleaner on the text accounts once per application; persist the cleaned frame."""
    from riskspark.operators.clean import Cleaner
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        raw = accounts_as_text(spark, sf_dir)
        _MODELS[key] = Cleaner().fit_on_training_rows(raw)
    model = _MODELS[key]
    clean = persisted(spark, sf_dir, "clean",
                      lambda s, d: model.transform(accounts_as_text(s, d)))
    return model, clean


@register("cleaned_accounts")
def q_cleaned(spark, sf_dir):
    _, clean = cleaning(spark, sf_dir)
    return clean


@register("null_profile")
def q_null_profile(spark, sf_dir):
    from riskspark.operators.clean import coerced_columns
    from riskspark.operators.profile import null_fractions
    raw = accounts_as_text(spark, sf_dir)
    feats = [c for c in raw.columns if c not in ("account_id", "F3924")]
    return null_fractions(raw.select(*coerced_columns(raw, feats)), feats)


@register("dataset_summary")
def q_dataset_summary(spark, sf_dir):
    from riskspark.operators.profile import dataset_stats
    model, clean = cleaning(spark, sf_dir)
    return dataset_stats(spark, clean, model.output_features, len(model.dropped_null_columns)).drop(
        "xor_digest", "sum_digest")


@register("feature_type_breakdown")
def q_feature_types(spark, sf_dir):
    from riskspark.operators.profile import feature_types
    model, clean = cleaning(spark, sf_dir)
    return feature_types(clean, model.output_features)


@register("feature_type_shares")
def q_feature_type_shares(spark, sf_dir):
    from riskspark.operators.profile import feature_types, type_breakdown
    model, clean = cleaning(spark, sf_dir)
    return type_breakdown(feature_types(clean, model.output_features))


@register("hint_profile")
def q_hint_profile(spark, sf_dir):
    from riskspark.operators.profile import hint_table
    _, clean = cleaning(spark, sf_dir)
    return hint_table(spark, clean, "y")


@register("class_rate_by_occupation")
def q_class_rate(spark, sf_dir):
    from riskspark.functions.scoring import decode_occupation
    from riskspark.operators.profile import class_rate_by
    acc = accounts_p(spark, sf_dir).select(decode_occupation(F.col("F3891")).alias("occupation"),
                                         F.col("F3924").alias("y"))
    return class_rate_by(acc, "occupation")


@register("column_medians")
def q_medians(spark, sf_dir):
    from riskspark.operators.refine import medians
    model, clean = cleaning(spark, sf_dir)
    return spark.createDataFrame(list(medians(clean, model.features).items()), "feature string, median double")


@register("feature_labels")
def q_feature_labels(spark, sf_dir):
    from riskspark.functions.text import feature_label
    from riskspark.operators.clean import coerced_columns
    from riskspark.operators.profile import null_fractions
    raw = accounts_as_text(spark, sf_dir)
    feats = [c for c in raw.columns if c not in ("account_id", "F3924")]
    nf = null_fractions(raw.select(*coerced_columns(raw, feats)), feats)
    return nf.select("feature", feature_label(F.col("feature")).alias("label"), "n_non_null")


# ---------------------------------------------------------------- validation metrics
def model_scores(spark, sf_dir) -> DataFrame:
    """Long ``(model, account_id, y, p)``: model B = p, model A = p2 (leak-driven)."""
    s = scored_p(spark, sf_dir)
    b = s.select(F.lit("B").alias("model"), "account_id", F.col("F3924").alias("y"), "p")
    a = s.select(F.lit("A").alias("model"), "account_id", F.col("F3924").alias("y"),
                 F.col("p2").alias("p"))
    return a.unionByName(b)


@register("pr_curve")
def q_pr_curve(spark, sf_dir):
    from riskspark.operators.metrics import curve
    return curve(model_scores(spark, sf_dir), "y", "p", ["model"])


@register("tuned_threshold")
def q_tuned_threshold(spark, sf_dir):
    from riskspark.operators.metrics import tune_threshold
    return tune_threshold(model_scores(spark, sf_dir), "y", "p", ["model"])


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    from riskspark.operators.metrics import model_metrics
    thr = spark.createDataFrame([("A", FIXED_THRESHOLD), ("B", FIXED_THRESHOLD)],
                                "model string, threshold double")
    return model_metrics(model_scores(spark, sf_dir), thr)


# ---------------------------------------------------------------- sampling / selection
def labelled_accounts(spark, sf_dir) -> DataFrame:
    return accounts_p(spark, sf_dir).select("*", F.col("F3924").alias("y"))


@register("stratified_split_counts")
def q_split_counts(spark, sf_dir):
    from riskspark.operators.sampling import stratified_split
    s = stratified_split(labelled_accounts(spark, sf_dir), "y", "account_id", 0.2, 42)
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count_if("is_test").alias("n_test"))


@register("stratified_fold_counts")
def q_fold_counts(spark, sf_dir):
    from riskspark.operators.sampling import stratified_folds
    s = stratified_folds(labelled_accounts(spark, sf_dir), 5, "y", "account_id", 43)
    return s.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


_PROFILE: dict = {}


def column_profile(spark, sf_dir) -> tuple[dict, dict]:
    """Medians and mutual information of the cleaned columns, once per application."""
    from riskspark.operators.refine import label_information, medians
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PROFILE:
        model, clean = cleaning(spark, sf_dir)
        middle = medians(clean, model.output_features)
        _PROFILE[key] = middle, label_information(clean, model.output_features, middle)
    return _PROFILE[key]


def _mi(spark, sf_dir, features=None) -> DataFrame:
    from riskspark.operators.selection import information_table
    scores = column_profile(spark, sf_dir)[1]
    return information_table(spark, {f: v for f, v in scores.items() if features is None or f in features})


@register("mutual_information")
def q_mutual_information(spark, sf_dir):
    return _mi(spark, sf_dir)


def _selection(spark, sf_dir, include_leakage, cfg=DEFAULT_CONFIG, top_k=None):
    from riskspark.operators.selection import select_features
    model, _ = cleaning(spark, sf_dir)
    feats = [f for f in model.output_features if include_leakage or f != "F3912"]
    return select_features(spark, _mi(spark, sf_dir, feats), feats, cfg, include_leakage, top_k)


@register("feature_selection_cut")
def q_selection_cut(spark, sf_dir):
    """K3 with fewer hints and ranks than columns, so that the MI order decides."""
    return _selection(spark, sf_dir, True, replace(DEFAULT_CONFIG, hints=("F115", "F3043")), 6)


@register("feature_selection_model_a")
def q_selection_a(spark, sf_dir):
    return _selection(spark, sf_dir, True)


@register("feature_selection_model_b")
def q_selection_b(spark, sf_dir):
    return _selection(spark, sf_dir, False)


@register("top_mi_features")
def q_top_mi(spark, sf_dir):
    return _mi(spark, sf_dir) \
        .orderBy(F.col("mi").desc(), F.col("feature")).limit(5)


@register("imputed_features")
def q_imputed(spark, sf_dir):
    from riskspark.operators.selection import FeatureModel
    model, clean = cleaning(spark, sf_dir)
    fm = FeatureModel(list(model.output_features), column_profile(spark, sf_dir)[0])
    return fm.transform(clean, keep=("account_id", "y"))


# ---------------------------------------------------------------- learning
_TRAINED: dict = {}


def doc_features_p(spark, sf_dir) -> DataFrame:
    from riskspark.sources.fixtures import doc_features
    return persisted(spark, sf_dir, "doc_features", doc_features)


DOC_FEATURES = ["n_chars", "n_spaces", "n_digits", "n_upper", "n_lines"]


def trained_models(spark, sf_dir) -> dict:
    """Models A and B trained once per application on the cleaned accounts."""
    from riskspark.plans.learn import train_models
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        model, clean = cleaning(spark, sf_dir)
        models = train_models(clean, model.output_features, split=model.split(clean))
        models["A"].cleaner = models["B"].cleaner = model
        _TRAINED[key] = models
    return _TRAINED[key]


@register("smote_class_counts")
def q_smote_counts(spark, sf_dir):
    from riskspark.operators.smote import smote
    docs = doc_features_p(spark, sf_dir)
    return smote(docs, DOC_FEATURES, "y", "account_id").groupBy("y", "synthetic") \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@register("minority_neighbours")
def q_minority_neighbours(spark, sf_dir):
    """C4: the five nearest minority neighbours of each distinct minority point, by slot."""
    from riskspark.operators.knn import exact_knn
    pos = doc_features_p(spark, sf_dir).where(F.col("y") == 1)
    points = pos.groupBy(F.array(*[F.col(f).cast("double") for f in DOC_FEATURES]).alias("vec")).agg(
        F.min("account_id").cast("long").alias("pid"), F.count(F.lit(1)).alias("mult"))
    near = exact_knn(points, 5, len(DOC_FEATURES)).select("pid", F.posexplode("neighbours").alias("slot", "nb"))
    return near.select("pid", "slot", F.col("nb.nid").alias("neighbour"), F.col("nb.dist").alias("distance"))


@register("model_training_summary")
def q_training_summary(spark, sf_dir):
    from riskspark.plans.learn import training_summary
    return training_summary(spark, trained_models(spark, sf_dir)).select(
        "model", "includes_leakage", "n_features", "n_train")


@register("model_feature_importance")
def q_model_feature_importance(spark, sf_dir):
    """M9: share of the split gain by feature and model."""
    ms = trained_models(spark, sf_dir)
    rows = [(m, f, float(v)) for m in ("A", "B") for f, v in ms[m].model.importance().items()]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


@register("held_out_scores")
def q_held_out_scores(spark, sf_dir):
    ms = trained_models(spark, sf_dir)
    test = ms["split"].where(F.col("is_test"))
    parts = [ms[m].predict(test).select(F.lit(m).alias("model"), "account_id", "y", "p") for m in ("A", "B")]
    return parts[0].unionByName(parts[1])


@register("held_out_metrics")
def q_held_out_metrics(spark, sf_dir):
    from riskspark.operators.metrics import model_metrics
    ms = trained_models(spark, sf_dir)
    thr = spark.createDataFrame([(m, float(ms[m].threshold)) for m in ("A", "B")],
                                "model string, threshold double")
    return model_metrics(q_held_out_scores(spark, sf_dir), thr)


# ---------------------------------------------------------------- network
def network_inputs(spark, sf_dir):
    from riskspark.sources.fixtures import entity_attributes, entity_scores
    edges = persisted(spark, sf_dir, "entity_attributes", entity_attributes)
    scores = persisted(spark, sf_dir, "entity_scores", entity_scores)
    return edges, scores


def components_p(spark, sf_dir):
    from riskspark.operators.network import connected_components
    edges, _ = network_inputs(spark, sf_dir)
    return persisted(spark, sf_dir, "components", lambda s, d: connected_components(edges))


@register("attribute_links")
def q_attribute_links(spark, sf_dir):
    from riskspark.operators.network import attribute_degrees
    edges, _ = network_inputs(spark, sf_dir)
    return attribute_degrees(edges)


@register("risk_propagation")
def q_risk_propagation(spark, sf_dir):
    from riskspark.operators.network import propagate_one_hop
    edges, scores = network_inputs(spark, sf_dir)
    return propagate_one_hop(edges, scores).select("entity", "score", "propagated")


@register("risk_components")
def q_risk_components(spark, sf_dir):
    return components_p(spark, sf_dir)


@register("campaign_summary")
def q_campaign_summary(spark, sf_dir):
    from riskspark.operators.network import component_summary
    edges, scores = network_inputs(spark, sf_dir)
    return component_summary(components_p(spark, sf_dir), scores, edges)


@register("campaign_lookup")
def q_campaign_lookup(spark, sf_dir):
    from riskspark.operators.network import campaign_lookup, component_summary
    from riskspark.sources.fixtures import table
    edges, scores = network_inputs(spark, sf_dir)
    comps = components_p(spark, sf_dir)
    req = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return campaign_lookup(req, component_summary(comps, scores, edges), comps)


# ---------------------------------------------------------------- case text / cases / stream
def case_analysis(spark, sf_dir) -> DataFrame:
    """X4 over the fixed-probability accounts (no model): flat analysis + report."""
    from riskspark.plans.pipeline import analyze
    return persisted(spark, sf_dir, "case_analysis",
                     lambda s, d: analyze(scored_p(s, d), "p", FIXED_THRESHOLD))


@register("case_reports")
def q_case_reports(spark, sf_dir):
    return case_analysis(spark, sf_dir).select("account_id", "case_id", "report", "report_source")


@register("report_sections")
def q_report_sections(spark, sf_dir):
    from riskspark.operators.casetext import report_sections
    return report_sections(case_analysis(spark, sf_dir).select("account_id", "report"), "account_id", "report")


def assistant_texts(spark, sf_dir) -> DataFrame:
    from riskspark.sources.fixtures import table
    conv = table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "assistant").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"),
        F.col("text"))


@register("conversation_sections")
def q_conversation_sections(spark, sf_dir):
    from riskspark.operators.casetext import report_sections
    return report_sections(assistant_texts(spark, sf_dir), "text_id", "text")


@register("generated_text_gate")
def q_generated_text_gate(spark, sf_dir):
    from riskspark.functions.text import strip_reasoning
    from riskspark.operators.casetext import gate_generated
    t = assistant_texts(spark, sf_dir)
    text, source = gate_generated(F.col("text"), F.lit("HIGH"), F.lit("<fallback report>"))
    return t.select("text_id", strip_reasoning(F.col("text")).alias("stripped"),
                    text.alias("final_text"), source.alias("report_source"))


@register("case_prompts")
def q_case_prompts(spark, sf_dir):
    from riskspark.operators.casetext import build_prompt
    a = case_analysis(spark, sf_dir)
    return a.select("account_id", build_prompt(a).alias("prompt"))


@register("str_drafts")
def q_str_drafts(spark, sf_dir):
    from riskspark.operators.casetext import str_draft
    a = case_analysis(spark, sf_dir)
    return a.select("account_id", str_draft(a).alias("str_draft"))


@register("case_playbooks")
def q_case_playbooks(spark, sf_dir):
    from riskspark.operators.casetext import playbook, regulatory_note
    a = case_analysis(spark, sf_dir).select("account_id", "severity", playbook(F.col("severity")).alias("pb"))
    return a.select("account_id", "severity", F.array_join("pb.actions", "|").alias("actions"),
                    F.col("pb.note").alias("note"), F.array_join("pb.workflow", "|").alias("workflow"),
                    regulatory_note(F.col("severity")).alias("regulatory_note"))


def case_rows(spark, sf_dir) -> DataFrame:
    """FIXTURES §4.5: cases from the analysis; demo = id % 10 = 0; v2 for id % 7 = 0."""
    a = case_analysis(spark, sf_dir)
    v1 = a.select("case_id", F.col("account_id").cast("long").alias("account_id"), "risk_score", "severity",
                  "typology", "confidence", ((F.col("account_id") % 10) == 0).alias("is_demo"),
                  F.lit(1).cast("long").alias("version"), "report")
    v2 = v1.where((F.col("account_id") % 7) == 0).select(
        "case_id", "account_id", (F.col("risk_score") / 2).alias("risk_score"), F.lit("LOW").alias("severity"),
        "typology", "confidence", "is_demo", F.lit(2).cast("long").alias("version"), "report")
    return v1, v2


@register("case_store_upsert")
def q_case_upsert(spark, sf_dir):
    from riskspark.operators.cases import upsert
    v1, v2 = case_rows(spark, sf_dir)
    return upsert(v1, v2).select("case_id", "account_id", "risk_score", "severity", "is_demo", "version")


@register("case_listing")
def q_case_listing(spark, sf_dir):
    from riskspark.operators.cases import list_cases, upsert
    v1, v2 = case_rows(spark, sf_dir)
    return list_cases(upsert(v1, v2)).select("case_id", "risk_score", "severity")


@register("clear_uploaded_cases")
def q_clear_uploaded(spark, sf_dir):
    from riskspark.operators.cases import clear_uploaded
    v1, _ = case_rows(spark, sf_dir)
    kept, removed = clear_uploaded(v1)
    return removed


@register("demo_case_seeding")
def q_demo_seeding(spark, sf_dir):
    from riskspark.operators.cases import new_cases
    v1, v2 = case_rows(spark, sf_dir)
    existing = v1.where(~F.col("is_demo"))
    demo = v1.where(F.col("is_demo"))
    return new_cases(existing, demo).agg(F.count(F.lit(1)).alias("new_demo_cases"))


@register("case_lookup_priority")
def q_case_lookup(spark, sf_dir):
    from riskspark.operators.cases import lookup_with_fallback
    v1, v2 = case_rows(spark, sf_dir)
    demo = v1.where(F.col("is_demo")).select("case_id", "risk_score", F.lit("demo").alias("source"))
    store = v2.select("case_id", "risk_score", F.lit("store").alias("source"))
    return lookup_with_fallback([(0, demo), (1, store)]).select("case_id", "risk_score", "source")


@register("high_severity_cases")
def q_high_severity(spark, sf_dir):
    from riskspark.operators.cases import high_severity
    return high_severity(case_analysis(spark, sf_dir)).select("case_id", "severity", "risk_score")


@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf_dir):
    from riskspark.operators.cases import dashboard_kpis
    return dashboard_kpis(case_analysis(spark, sf_dir))


@register("analytics_kpis")
def q_analytics_kpis(spark, sf_dir):
    from riskspark.operators.cases import analytics_kpis
    from riskspark.plans.analyze import flagged
    return analytics_kpis(flagged(case_analysis(spark, sf_dir)))


@register("single_account_json")
def q_single_account_json(spark, sf_dir):
    """A5: accounts round-tripped through JSON feature dicts score exactly like the batch."""
    from riskspark.plans.pipeline import parse_feature_json
    s = scored_p(spark, sf_dir)
    lines = s.select(F.to_json(F.struct(*[F.col(c) for c in s.columns])).alias("value"))
    parsed = parse_feature_json(lines, s.schema)
    return assess(parsed, "p", FIXED_THRESHOLD).select(
        "account_id", "risk_score", "risk_probability", "severity", "recommended_action",
        "occupation", "standing", *IND_COLS)


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """Accounts written as JSON files, scored by Structured Streaming (availableNow)."""
    import uuid
    from riskspark.session import shared_dir
    from riskspark.streaming.scoring import read_account_stream, score_stream, write_scores
    s = scored_p(spark, sf_dir)
    base = shared_dir(spark, f"stream-{uuid.uuid4().hex}")
    s.repartition(4).write.json(f"{base}/in")
    stream = read_account_stream(spark, f"{base}/in", s.schema, max_files_per_trigger=2)
    out = score_stream(stream, lambda df: assess(df, "p", FIXED_THRESHOLD).select(
        "account_id", "risk_score", "risk_probability", "severity", "recommended_action",
        "occupation", "standing", *IND_COLS))
    q = write_scores(out, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("dataset_fingerprint")
def q_fingerprint(spark, sf_dir):
    from riskspark.plans.pipeline import dataset_fingerprint
    return dataset_fingerprint(accounts_p(spark, sf_dir))


# ---------------------------------------------------------------- explanation
def _scored_by_b(spark, sf_dir):
    ms = trained_models(spark, sf_dir)
    _, clean = cleaning(spark, sf_dir)
    b = ms["B"]
    return ms, b, b.score(clean)


@register("shap_top_cases")
def q_shap_top_cases(spark, sf_dir):
    """X1 + K5 + F17: top-10 attributions of model B for its 25 highest flagged accounts."""
    from riskspark.operators.explain import explain_rows, top_attributions
    ms, b, joined = _scored_by_b(spark, sf_dir)
    top = top_cases(assess(joined, "p", b.threshold), "account_id", 25)
    prepared = b.features.transform(top, keep=("account_id",))
    return top_attributions(explain_rows(prepared, b.model, b.features.selected, n=10), 10)


@register("global_importance")
def q_global_importance(spark, sf_dir):
    """X2 + K6: mean |attribution| over all held-out accounts."""
    from riskspark.operators.explain import explain_rows, global_importance
    ms = trained_models(spark, sf_dir)
    b = ms["B"]
    test = ms["split"].where(F.col("is_test"))
    held_out = b.features.transform(test, keep=("account_id",))
    return global_importance(explain_rows(held_out, b.model, b.features.selected), 20)


@register("risk_propagation_rounds")
def q_risk_propagation_rounds(spark, sf_dir):
    """N2 over three rounds: risk = max(own, 0.8 x best neighbour risk), repeated."""
    from riskspark.operators.network import propagate
    edges, scores = network_inputs(spark, sf_dir)
    return propagate(edges, scores, rounds=3)


@register("stream_case_persistence")
def q_stream_case_persistence(spark, sf_dir):
    """Case rows arriving as JSON files are upserted batch by batch into a versioned store."""
    import uuid
    from riskspark.operators.cases import CaseStore
    from riskspark.session import shared_dir
    from riskspark.streaming.scoring import persist_cases, read_account_stream
    v1, _ = case_rows(spark, sf_dir)
    rows = v1.drop("version")
    base = shared_dir(spark, f"stream-cases-{uuid.uuid4().hex}")
    rows.repartition(4).write.json(f"{base}/in")
    store = CaseStore(spark, f"{base}/store")
    persist_cases(read_account_stream(spark, f"{base}/in", rows.schema, max_files_per_trigger=2),
                  store, f"{base}/ckpt").awaitTermination()
    return store.read().select("case_id", "account_id", "risk_score", "severity", "is_demo")


@register("schema_violations")
def q_schema_violations(spark, sf_dir):
    """Analysis records outside their ranges (expected: none)."""
    from riskspark.plans.analyze import analysis_records, validate
    return validate(analysis_records(analysis(spark, sf_dir))).select(
        "account_id", "risk_score", "risk_probability", F.col("classification.confidence").alias("confidence"))


@register("leakage_report")
def q_leakage_report(spark, sf_dir):
    """Per feature, precision / recall of value >= 1 as a mule flag, with its MI."""
    from riskspark.operators.profile import wide_leakage_report
    model, clean = cleaning(spark, sf_dir)
    return wide_leakage_report(clean, model.output_features, "y", _mi(spark, sf_dir))


@register("pipeline_cases")
def q_pipeline_cases(spark, sf_dir):
    """The batch pipeline (clean -> score with model B -> top cases -> TreeSHAP -> reports)."""
    from riskspark.plans.pipeline import run_pipeline
    out = run_pipeline(spark, accounts_as_text(spark, sf_dir), models=trained_models(spark, sf_dir))
    return out["cases"].select("account_id", "case_id", "risk_score", "severity", "typology",
                               F.size("shap_values").alias("n_attributions"), "report")


@register("table_fingerprint")
def q_table_fingerprint(spark, sf_dir):
    """A4 over a table whose JSON form SQL can write too."""
    from riskspark.operators.fingerprint import dataset_fingerprint
    from riskspark.sources.fixtures import table
    return dataset_fingerprint(table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@register("cleaning_metadata")
def q_cleaning_metadata(spark, sf_dir):
    """What the cleaner learned from the training rows."""
    model, _ = cleaning(spark, sf_dir)
    return model.metadata(spark).select(
        "n_rows", "n_features", "n_dropped", "n_missing_indicators",
        F.array_join("dropped_null_columns", "|").alias("dropped"),
        F.array_join("missing_indicator_columns", "|").alias("missing"))


@register("hints_by_ks")
def q_hints_by_ks(spark, sf_dir):
    """K8: hint features by their KS statistic."""
    from riskspark.operators.profile import hint_table, rank_hints_by_ks
    _, clean = cleaning(spark, sf_dir)
    return rank_hints_by_ks(hint_table(spark, clean, "y")).select("feature", "ks_stat", "discriminative_power")


@register("class_weights")
def q_class_weights(spark, sf_dir):
    """Each account's training weight (positives weigh the measured ratio)."""
    from riskspark.plans.learn import class_weight, with_weight
    rows = labelled_accounts(spark, sf_dir).select("account_id", "y")
    return with_weight(rows, "y", class_weight(rows, "y", DEFAULT_CONFIG)).withColumnRenamed("_w", "weight")


@register("case_lookup")
def q_case_lookup_one(spark, sf_dir):
    """The latest version of one case."""
    from riskspark.operators.cases import get_case, upsert
    v1, v2 = case_rows(spark, sf_dir)
    return get_case(upsert(v1, v2), "BOI-00014").select("case_id", "account_id", "risk_score", "severity", "version")


def attribution_rows(spark, sf_dir) -> DataFrame:
    """Given attributions (not a model's): each value's distance from one half, scaled."""
    from riskspark.operators.profile import to_long
    model, clean = cleaning(spark, sf_dir)
    long = to_long(clean, model.features, ["account_id"])
    return long.select("account_id", "feature",
                       ((F.coalesce("value", F.lit(0.0)) - 0.5) * 0.25).alias("shap_value"),
                       F.coalesce("value", F.lit(0.0)).alias("feature_value"))


@register("top_attributions")
def q_top_attributions(spark, sf_dir):
    """K5 + F17: the ten largest attributions of each account."""
    from riskspark.operators.explain import top_attributions
    return top_attributions(attribution_rows(spark, sf_dir), 10)


@register("attribution_importance")
def q_attribution_importance(spark, sf_dir):
    """X2 + K6: mean size and sign of the attributions of each feature."""
    from riskspark.operators.explain import global_importance
    return global_importance(attribution_rows(spark, sf_dir), 8)


@register("risk_propagation_typed")
def q_risk_propagation_typed(spark, sf_dir):
    """N1 + N2: links of two types built from the events, each with its own factor."""
    from riskspark.config import PROPAGATION_FACTORS
    from riskspark.operators.network import build_links, propagate_one_hop
    from riskspark.sources.fixtures import entity_scores, table
    slot = F.concat_ws("|", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH"),
                       F.floor(F.minute("ts") / 10).cast("string"))
    k = F.get_json_object("props", "$.k")
    events = table(spark, sf_dir, "events").select(
        "user_id", F.concat_ws("|", k, slot).alias("shares_device"),
        F.when(F.col("event_type") == "purchase", F.concat_ws("|", F.col("event_type"), slot)).alias("transferred_to"))
    links = build_links(events, "user_id", ["shares_device", "transferred_to"])
    scores = persisted(spark, sf_dir, "entity_scores", entity_scores)
    return propagate_one_hop(links, scores, factors=PROPAGATION_FACTORS)


@register("csv_accounts")
def q_csv_accounts(spark, sf_dir):
    """A1 + A6: accounts written as CSV, read as text and cleaned by the fitted cleaner."""
    import uuid
    from riskspark.operators.clean import drop_index_column, read_accounts_csv
    from riskspark.session import shared_dir
    path = shared_dir(spark, f"csv-{uuid.uuid4().hex}")
    accounts_as_text(spark, sf_dir).write.option("header", True).csv(path)
    model, _ = cleaning(spark, sf_dir)
    return model.transform(drop_index_column(read_accounts_csv(spark, path)))


MODEL_SCORES = ["account_id", "risk_score", "risk_probability", "severity", "typology"]


@register("json_model_scores")
def q_json_model_scores(spark, sf_dir):
    """A5 + D13: accounts as JSON feature dicts, cleaned and scored by model B."""
    from riskspark.plans.learn import choose_model
    from riskspark.plans.pipeline import parse_feature_json
    b = choose_model(trained_models(spark, sf_dir))
    raw = accounts_as_text(spark, sf_dir)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    return assess(b.score_raw(parse_feature_json(lines, raw.schema)), "p", b.threshold).select(*MODEL_SCORES)


@register("stream_model_scores")
def q_stream_model_scores(spark, sf_dir):
    """Accounts arriving as JSON files, cleaned and scored by model B in the stream."""
    import uuid
    from riskspark.plans.learn import choose_model
    from riskspark.session import shared_dir
    from riskspark.streaming.scoring import read_account_stream, score_stream, write_scores
    b = choose_model(trained_models(spark, sf_dir))
    raw = accounts_as_text(spark, sf_dir)
    base = shared_dir(spark, f"stream-model-{uuid.uuid4().hex}")
    raw.repartition(4).write.json(f"{base}/in")
    out = score_stream(read_account_stream(spark, f"{base}/in", raw.schema, max_files_per_trigger=2),
                       lambda df: assess(b.score_raw(df), "p", b.threshold).select(*MODEL_SCORES))
    write_scores(out, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out")
