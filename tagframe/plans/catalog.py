"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query reads the driver tables (or data Spark derives from them) in full.
Doubles that come out of ``exp``/``avg`` are rounded so that the DuckDB
oracle compares equal to the last digit kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.functions import labels as L
from tagframe.functions import scores as S
from tagframe.operators import counts as A
from tagframe.operators import entities as E
from tagframe.operators import evaluate as V
from tagframe.operators import features as X
from tagframe.operators import reshape as R
from tagframe.operators import tagging as T
from tagframe.operators import windows as W
from tagframe.session import materialize, stored
from tagframe.sources import literals as LIT
from tagframe.sources import tables as TB

# Model, k-NN, batch and streaming modules are imported inside their queries:
# they pull in MLlib / pandas, which the relational queries do not need.
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TOP_K = 10
PREVIEW_N = 5
ERROR_SAMPLE_N = 5
WINDOW = 128
SEED = 42


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def _docs(spark, sf):
    return TB.documents(spark, sf)


def _ents_a(spark, sf):
    return E.tag_tokens(_docs(spark, sf))


def _labelled_docs(spark, sf):
    """Only documents that carry a label, so unlabelled text is never tagged."""
    keys = TB.table(spark, sf, "labels").select("doc_id")
    return _docs(spark, sf).join(keys, "doc_id", "left_semi")


def _labelled_ents_a(spark, sf):
    return E.tag_tokens(_labelled_docs(spark, sf))


def _ents_b(spark, sf):
    return E.tag_phrases(_docs(spark, sf))


# ---- scans, projections, filters ----------------------------------------

@query
def q_scan_text(spark, sf):
    return TB.documents(spark, sf)


@query
def q_scan_splits(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", TB.split_of(F.col("doc_id")).alias("split"))


@query
def q_scan_predictions(spark, sf):
    p = TB.predictions(spark, sf)
    return p.select("run", "doc_id", "label_binary", "logit0", "logit1", "prediction",
                    F.round("confidence", 9).alias("confidence"))


@query
def q_parse_entities(spark, sf):
    """Entity lists exported as Python-literal text and parsed back (S8 → S7 round trip)."""
    arrays = E.entity_arrays(_ents_a(spark, sf))
    as_entity = F.transform("entities", lambda e: F.struct(
        e["entity"].alias("entity"), e["score"].alias("score"), (e["pos"] + 1).cast("int").alias("index"),
        e["word"].alias("word"), e["start"].alias("start"), e["end"].alias("end")))
    text = arrays.select("doc_id", LIT.to_literal(as_entity).alias("raw"))
    parsed = LIT.parse_entities(text, "raw", "entities", mode="raise")
    out = parsed.select("doc_id", F.posexplode("entities").alias("pos", "e"))
    return out.select("doc_id", F.col("pos").cast("int").alias("pos"), "e.entity", "e.score", "e.index",
                      "e.word", "e.start", "e.end")


@query
def q_project_text(spark, sf):
    return TB.statements(spark, sf).select("doc_id", "label_binary", "text")


@query
def q_drop_columns(spark, sf):
    return TB.statements(spark, sf).drop("text")


@query
def q_label_isin(spark, sf):
    return TB.raw_labels(spark, sf).select("row_id", "label", L.label_isin("label").alias("label_binary"))


@query
def q_label_three_way(spark, sf):
    return TB.raw_labels(spark, sf).select("row_id", "label", L.label_three_way("label").alias("label_binary"),
                                           L.label_status("label").alias("label_status"))


@query
def q_label_inverted(spark, sf):
    return TB.raw_labels(spark, sf).select("row_id", "label", L.label_inverted("label").alias("label_binary"))


@query
def q_entity_display(spark, sf):
    return _ents_a(spark, sf).select("doc_id", "pos", L.entity_display("word", "entity").alias("display"))


@query
def q_label_map(spark, sf):
    m = L.class_map("label_binary")
    return TB.labelled_ids(spark, sf).select("doc_id", m["1"].alias("cat_1"), m["0"].alias("cat_0"))


@query
def q_preview(spark, sf):
    """First rows by key: the top keys come from the small label table, then their text by a join."""
    first = TB.labelled_ids(spark, sf).select("doc_id", "label_binary").orderBy("doc_id").limit(PREVIEW_N)
    return TB.documents(spark, sf).join(first, "doc_id").select("doc_id", "label_binary", "text")


@query
def q_filter_true(spark, sf):
    return TB.statements(spark, sf).where(F.col("label_binary") == 1).select("doc_id", "text")


@query
def q_filter_false(spark, sf):
    return TB.statements(spark, sf).where(F.col("label_binary") == 0).select("doc_id", "text")


@query
def q_error_outcome(spark, sf):
    p = TB.predictions(spark, sf)
    return p.select("run", "doc_id", L.outcome("label_binary", "prediction").alias("outcome"))


@query
def q_error_sample(spark, sf):
    """first misclassified rows per run with their text and raw entity list
    (Python-literal export); only the sampled documents are tagged."""
    p = TB.predictions(spark, sf).where(F.col("prediction") != F.col("label_binary"))
    w = Window.partitionBy("run").orderBy("doc_id")
    s = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ERROR_SAMPLE_N)
    as_entity = F.transform(E.token_entities("text"), lambda e: F.struct(
        e["entity"].alias("entity"), e["score"].alias("score"), (e["pos"] + 1).cast("int").alias("index"),
        e["word"].alias("word"), e["start"].alias("start"), e["end"].alias("end")))
    return (TB.documents(spark, sf).join(s, "doc_id")
            .select("run", "doc_id", "text", LIT.to_literal(as_entity).alias("A_raw_entities"), "prediction", "label_binary"))


@query
def q_valid_entities(spark, sf):
    """F6 on entities of both taggers made incomplete by their key and place: one field of each is missing."""
    ents = E.tag_all(_docs(spark, sf))
    lost = (F.col("doc_id") + F.col("pos")) % 7
    broken = ents.select("doc_id", "tagger", "pos", F.when(lost == 0, F.lit("")).when(lost != 1, F.col("entity")).alias("entity"),
                         F.when(lost == 2, F.lit("")).when(lost != 3, F.col("word")).alias("word"),
                         F.when(lost != 4, F.coalesce("start", "pos")).alias("start"),
                         F.when(lost != 5, F.coalesce("end", "pos")).alias("end"))
    return E.valid_entities(broken)


# ---- entity extraction and cleaning -------------------------------------

@query
def q_tag_tokens(spark, sf):
    return _ents_a(spark, sf).select("doc_id", "pos", "entity", "score", "word", "start", "end")


@query
def q_tag_multi(spark, sf):
    docs = _docs(spark, sf)
    return E.tagger_counts(docs, E.tag_all(docs))


@query
def q_tag_spans(spark, sf):
    s = E.tag_spans_rows(_docs(spark, sf), E.token_entities("text"))
    return s.select("doc_id", "pos", "entity", F.round("score", 6).alias("score"), "word", "start", "end", "n_tokens")


@query
def q_tag_phrases(spark, sf):
    return _ents_b(spark, sf).select("doc_id", "pos", "entity", "word")


@query
def q_tag_phrases_wide(spark, sf):
    """N6 with thirteen labels: phrases of a grammar over token classes."""
    from tagframe.operators import phrase_grammar as G
    return G.tag_grammar(_docs(spark, sf)).drop("tagger")


@query
def q_tag_gazetteer(spark, sf):
    """N1 by a name table: the entity spans of the benchmark items are the names, looked up in every document."""
    from tagframe.operators import gazetteer as GZ
    items = TB.table(spark, sf, "benchmark").select("item_id", "text")
    spans = E.tag_spans_rows(items, E.token_entities("text"), key="item_id")
    return GZ.tag_gazetteer(_docs(spark, sf), spans.select(F.col("word").alias("name"), F.col("entity").alias("label")))


@query
def q_entity_labels(spark, sf):
    arrays = E.entity_arrays(_ents_a(spark, sf))
    return arrays.select("doc_id", F.array_join(E.entity_labels("entities"), ",").alias("labels"))


@query
def q_clean_a_leading(spark, sf):
    s = E.byte_level_words(E.tag_spans_rows(_docs(spark, sf), E.token_entities("text")))
    return s.select("doc_id", "pos", F.col("word").alias("raw_word"), E.clean_leading("word").alias("word"))


@query
def q_clean_a_all(spark, sf):
    s = E.byte_level_words(E.tag_spans_rows(_docs(spark, sf), E.token_entities("text")))
    return s.select("doc_id", "pos", F.col("word").alias("raw_word"), E.clean_all("word").alias("word"))


@query
def q_merge_wordpiece(spark, sf):
    return E.merge_wordpiece(E.wordpieces(_ents_a(spark, sf)))


@query
def q_merge_wordpiece_keep(spark, sf):
    return E.merge_wordpiece_keep(E.wordpieces(_ents_a(spark, sf)))


@query
def q_explode_entities(spark, sf):
    docs = _docs(spark, sf)
    arrays = E.entity_arrays(E.tag_all(docs))
    return E.explode_entities(arrays).select("doc_id", "tagger", "pos", "entity", "word")


# ---- text tagging --------------------------------------------------------

@query
def q_tag_inline_tokens(spark, sf):
    return T.tag_rows(_docs(spark, sf), E.token_entities("text"))


@query
def q_tag_inline_cursor(spark, sf):
    return T.cursor_rows(_docs(spark, sf), E.phrase_entities("text"))


@query
def q_find_offsets(spark, sf):
    return T.offset_rows(_docs(spark, sf), E.phrase_entities("text"))


@query
def q_merge_adjacent(spark, sf):
    spans = T.merged(T.spans_of(E.token_entities("text"), False), False)
    return _docs(spark, sf).select("doc_id", F.inline(spans)).select("doc_id", "pos", "start", "end", "entity", "n_merged")


@query
def q_tag_xml_searched(spark, sf):
    return T.tag_searched_rows(_docs(spark, sf), E.phrase_entities("text"))


@query
def q_tag_xml(spark, sf):
    return T.tag_xml_rows(_docs(spark, sf), E.token_entities("text"))


@query
def q_label_vocab(spark, sf):
    return T.label_vocab(_ents_a(spark, sf))


@query
def q_tokenize_pad(spark, sf):
    tagged = T.tag_xml_rows(_docs(spark, sf), E.token_entities("text"))
    t = T.tokenize_pad(tagged, "tagged_text", WINDOW)
    return t.select("doc_id", "window_no", F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("n_real"))


def _subwords(spark, sf):
    """The vocabulary, and the sub-word ids of every tagged text."""
    from tagframe.operators import subwords as SW
    vocabulary = SW.Vocabulary()
    tagged = T.tag_xml_rows(_docs(spark, sf), E.token_entities("text"))
    return vocabulary, SW.encode(tagged, "tagged_text", vocabulary=vocabulary)


@query
def q_subword_ids(spark, sf):
    """Ids of every tagged text, markers whole, longest match over the vocabulary's pieces."""
    _, rows = _subwords(spark, sf)
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), F.array_join("ids", " ").alias("ids"))


@query
def q_subword_batches(spark, sf):
    """Batches of 16 texts of like length, padded to the longest row of the batch."""
    from tagframe.operators import subwords as SW
    vocabulary, rows = _subwords(spark, sf)
    out = SW.padded(stored(rows, "subwords"), vocabulary.pad)
    return out.select("doc_id", "batch_no", "batch_len", "n_tokens", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_real"))


# ---- aggregations, joins, windows ---------------------------------------

@query
def q_class_counts(spark, sf):
    return A.class_counts(TB.labelled_ids(spark, sf))


@query
def q_class_balance(spark, sf):
    return A.class_balance(TB.labelled_ids(spark, sf))


@query
def q_class_priors(spark, sf):
    t = TB.labelled_ids(spark, sf).where(F.col("split") == "train")
    return A.class_priors(t).select(F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))


def _word_counts(spark, sf):
    docs = _labelled_docs(spark, sf)
    return A.word_entity_counts(E.tag_all(docs), TB.labelled_ids(spark, sf))


@query
def q_word_entity_counts(spark, sf):
    return _word_counts(spark, sf)


@query
def q_clean_entity_counts(spark, sf):
    """A3 after cleaning, as the reports count: byte-level spans without their marks (C1) and glued word pieces."""
    tokens = _labelled_ents_a(spark, sf)
    spans = E.byte_level_words(E.tag_spans(tokens)).select("doc_id", F.lit("byte_level").alias("tagger"), "pos",
                                                           E.clean_leading("word").alias("word"), "entity")
    words = E.merge_wordpiece(E.wordpieces(tokens)).select("doc_id", F.lit("wordpiece").alias("tagger"), "pos", "word", "entity")
    return A.word_entity_counts(spans.unionByName(words), TB.labelled_ids(spark, sf))


@query
def q_top_entities(spark, sf):
    return A.top_k(_word_counts(spark, sf), TOP_K)


@query
def q_tag_frequency(spark, sf):
    return A.tag_frequency(_ents_a(spark, sf))


@query
def q_tags_zero_filled(spark, sf):
    return A.zero_fill_tags(A.tag_frequency(_ents_a(spark, sf)), spark)


@query
def q_error_tag_counts(spark, sf):
    return A.error_tag_counts(TB.predictions(spark, sf), _labelled_ents_a(spark, sf), spark)


@query
def q_run_comparison(spark, sf):
    return A.run_comparison(A.error_tag_counts(TB.predictions(spark, sf), _labelled_ents_a(spark, sf), spark))


@query
def q_entity_pivot(spark, sf):
    return X.entity_pivot(_ents_a(spark, sf), E.TAGS_A)


@query
def q_entity_features(spark, sf):
    return X.entity_features(TB.labelled_ids(spark, sf), _labelled_ents_a(spark, sf), E.TAGS_A)


@query
def q_entity_features_b(spark, sf):
    ents = E.tag_phrases(_labelled_docs(spark, sf))
    return X.entity_features(TB.labelled_ids(spark, sf), ents, E.TAGS_B)


@query
def q_features_aligned(spark, sf):
    lab = TB.labelled_ids(spark, sf)
    ents = _labelled_ents_a(spark, sf)
    return X.entity_features(lab.where(F.col("split") == "test"), ents, sorted(E.TAGS_A))


def _worded(ents):
    """Entities labelled by class and word: a vocabulary that grows with the data."""
    return ents.select("doc_id", F.concat_ws("=", "entity", "word").alias("entity"))


def _vocabulary(spark, sf):
    train = TB.labelled_ids(spark, sf).where(F.col("split") == "train").select("doc_id")
    return X.fit_vocabulary(_worded(_labelled_ents_a(spark, sf)).join(train, "doc_id", "left_semi"))


@query
def q_feature_vocabulary(spark, sf):
    """The label dictionary found in the training rows."""
    return _vocabulary(spark, sf)


@query
def q_features_sparse(spark, sf):
    """Test rows over the training vocabulary; labels that only test has are dropped."""
    test = TB.labelled_ids(spark, sf).where(F.col("split") == "test")
    ents = _worded(_labelled_ents_a(spark, sf)).join(test.select("doc_id"), "doc_id", "left_semi")
    got = X.sparse_features(test, ents, _vocabulary(spark, sf))
    return got.select("doc_id", "label_binary", F.size("features").alias("n_features"), F.array_join(F.transform(
        "features", lambda e: F.concat_ws(":", e["feature_id"].cast("string"), e["n"].cast("string"))), ",").alias("features"))


@query
def q_seeded_shuffle(spark, sf):
    return W.seeded_shuffle(TB.labelled_ids(spark, sf).select("doc_id", "split"), seed=SEED)


@query
def q_mini_batches(spark, sf):
    m = W.mini_batches(TB.labelled_ids(spark, sf).select("doc_id", "split"), seed=SEED)
    return m.select("doc_id", "split", "batch_no")


@query
def q_train_full(spark, sf):
    return R.train_full(TB.labelled_ids(spark, sf))


# ---- predictions and evaluation -----------------------------------------

METRICS = ("accuracy", "precision", "recall", "f1")


@query
def q_score_predictions(spark, sf):
    p = TB.predictions(spark, sf)
    logits = F.array("logit0", "logit1")
    return p.select("run", "doc_id", S.argmax(logits).alias("pred_argmax"),
                    F.round(F.element_at(S.softmax(logits), 2), 9).alias("confidence"),
                    S.threshold_class("confidence").alias("pred_threshold"))


@query
def q_binary_metrics(spark, sf):
    return V.binary_metrics(TB.predictions(spark, sf))


@query
def q_weighted_metrics(spark, sf):
    return V.weighted_metrics(TB.predictions(spark, sf))


@query
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix(TB.predictions(spark, sf), spark)


@query
def q_roc_curve(spark, sf):
    r = V.roc_curve(TB.predictions(spark, sf), start=True)
    return r.select("run", F.round("score", 9).alias("score"), "tp", "fp", "tpr", "fpr")


@query
def q_roc_curve_logit(spark, sf):
    """The same curve on the raw class-1 logit."""
    r = V.roc_curve(TB.predictions(spark, sf), score="logit1", start=True)
    return r.select("run", F.round("score", 9).alias("score"), "tp", "fp", "tpr", "fpr")


@query
def q_auc(spark, sf):
    return V.auc(V.roc_curve(TB.predictions(spark, sf)))


@query
def q_metrics_long(spark, sf):
    m = V.binary_metrics(TB.predictions(spark, sf))
    return R.metrics_long(m, ["run"], METRICS)


@query
def q_metrics_wide(spark, sf):
    m = V.binary_metrics(TB.predictions(spark, sf))
    return R.metrics_wide(R.metrics_long(m, ["run"], METRICS), "run", METRICS)


def _random_predictions(spark, sf):
    """M7: class 1 with the training share of class 1, drawn from the key."""
    lab = TB.labelled_ids(spark, sf)
    priors = A.class_priors(lab.where(F.col("split") == "train")).select(F.lit("test").alias("split"), "p1")  # one row
    test = lab.where(F.col("split") == "test").join(priors, "split")
    return test.select("doc_id", "label_binary", (S.uniform("doc_id", SEED) < F.col("p1")).cast("int").alias("prediction"))


@query
def q_random_baseline(spark, sf):
    return _random_predictions(spark, sf)


# ---- model jobs ------------------------------------------------------------

TAGGERS = {"A": (E.token_entities, E.TAGS_A), "B": (E.phrase_entities, E.TAGS_B)}


def _count_features(spark, sf, tagger="A"):
    """Entity-count features of every labelled document, checkpointed once: the
    train and test sides (and k-NN's repeated reads) all come from one tagging pass."""
    lab = TB.labelled_ids(spark, sf)
    entities, vocab = TAGGERS[tagger]
    ents = _labelled_docs(spark, sf).select("doc_id", F.inline(entities("text")))
    feats = X.entity_features(lab.select("doc_id", "label_binary", "split"), ents, vocab, extra=("label_binary", "split"))
    feats = materialize(feats)
    return R.train_full(feats), feats.where(F.col("split") == "test")


def _count_model_preds(spark, sf, models=("logreg", "svm", "tree", "knn"), tagger="A"):
    from tagframe.operators import models as M
    train, test = _count_features(spark, sf, tagger)
    return M.fit_count_models(train, test, TAGGERS[tagger][1], models=models)


@query
def q_clf_logreg(spark, sf):
    return _count_model_preds(spark, sf, ("logreg",))


@query
def q_clf_svm(spark, sf):
    return _count_model_preds(spark, sf, ("svm",))


@query
def q_clf_tree(spark, sf):
    return _count_model_preds(spark, sf, ("tree",))


def _scoreboard_rows(spark, sf, models):
    """Predictions of the models on the features of both taggers, and of the random baseline."""
    rows = _random_predictions(spark, sf).select("doc_id", "label_binary", F.lit("random").alias("model"), "prediction",
                                                 F.explode(F.array(F.lit("A"), F.lit("B"))).alias("tagger"))
    for tagger in TAGGERS:
        p = _count_model_preds(spark, sf, models, tagger).withColumn("tagger", F.lit(tagger))
        rows = rows.unionByName(p.select("doc_id", "label_binary", "model", "prediction", "tagger"))
    return rows


@query
def q_model_scoreboard(spark, sf):
    from tagframe.operators import models as M
    return M.scoreboard(_scoreboard_rows(spark, sf, M.MODELS), by=("tagger", "model"))


@query
def q_scoreboard_exact(spark, sf):
    """The part of the scoreboard that does not depend on an optimiser: k-NN and the random baseline."""
    from tagframe.operators import models as M
    return M.scoreboard(_scoreboard_rows(spark, sf, ("knn",)), by=("tagger", "model"))


@query
def q_run_records(spark, sf):
    """One record per run of the prediction table, written as Parquet and read back."""
    from tagframe.session import ensure_checkpoint_dir
    from tagframe.sources import files
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-records-{uuid.uuid4().hex}"
    metrics = V.binary_metrics(TB.predictions(spark, sf)).select("run", "accuracy", "precision", "recall", "f1")
    files.append_run_record(spark, path, {"seed": SEED, "threshold": 0.5}, metrics)
    return spark.read.parquet(path).select("run", "seed", "threshold", "accuracy", "precision", "recall", "f1")


def _text_splits(spark, sf, tagged: bool):
    docs = _labelled_docs(spark, sf)
    col = "text"
    if tagged:
        docs = T.tag_xml_rows(docs, E.token_entities("text")).withColumnRenamed("tagged_text", "text").drop("n_spans")
    st = materialize(docs.join(TB.labelled_ids(spark, sf), "doc_id"))  # train and test read it
    return R.train_full(st), st.where(F.col("split") == "test"), col


@query
def q_text_classifier(spark, sf):
    from tagframe.operators import models as M
    train, test, col = _text_splits(spark, sf, tagged=False)
    return M.text_classifier(train, test, col, "untagged")


@query
def q_tag_ablation(spark, sf):
    from tagframe.operators import models as M
    preds = None
    for tagged in (False, True):
        train, test, col = _text_splits(spark, sf, tagged)
        p = M.text_classifier(train, test, col, "tagged" if tagged else "untagged")
        preds = p if preds is None else preds.unionByName(p)
    return V.binary_metrics(preds)


def _tagged_splits(spark, sf, tagged: bool):
    """Labelled documents with their text, plain or tagged: labels join the keys first, so unlabelled text is not read on."""
    docs = _labelled_docs(spark, sf)
    if tagged:
        docs = T.tag_xml_rows(docs, E.token_entities("text")).withColumnRenamed("tagged_text", "text").drop("n_spans")
    return docs.join(TB.labelled_ids(spark, sf), "doc_id")


@query
def q_sweep(spark, sf):
    """60 configs (epochs x batch size x learning rate), patience 5, on the tagged text."""
    from tagframe.operators import bag_of_words as B
    st = _tagged_splits(spark, sf, tagged=True)
    split = TB.split_of(F.col("doc_id"))  # by the key: either part is tagged once
    return B.sweep(st.where(split == "train"), st.where(split == "valid"), "text",
                   W.config_grid(spark, lrs=B.SWEEP_RATES))


@query
def q_bow_predictions(spark, sf):
    """M8: ten passes of mini-batches of 8 with dropout 0.2 over train and valid, predictions of test."""
    from tagframe.operators import bag_of_words as B
    rows = B.hashed(_tagged_splits(spark, sf, tagged=False), "text")
    split = TB.split_of(F.col("key"))
    return B.predict(rows.where(split == "test"), B.fit(rows.where(split != "test")))


@query
def q_best_run(spark, sf):
    """W5 over the training logs: of each label's runs the one whose last epoch has the highest F1."""
    stats = W.epoch_stats(TB.epoch_logs(spark, sf), by=("run", "label"))
    last = stats.where(F.col("epoch") == TB.LOG_EPOCHS).select("label", "run", F.round("eval_f1", 9).alias("f1"))
    return W.best_run(last, "f1", "run", by=("label",))


# ---- batched Python tagger and streaming -----------------------------------

@query
def q_tag_batched(spark, sf):
    from tagframe.operators import batch as B
    return B.tag_batched(TB.documents(spark, sf)).select("doc_id", "pos", "entity", "score", "word", "start", "end")


@query
def q_stream_tag_xml(spark, sf):
    from tagframe.streaming import tagging as ST
    out = ST.run_tag_xml(spark, sf)
    return spark.read.parquet(out).select("doc_id", "tagged_text", "n_spans")


@query
def q_knn_predict(spark, sf):
    from tagframe.operators import knn as K
    train, test = _count_features(spark, sf)
    return K.knn_predict(train, test, E.TAGS_A, k=10)


# ---- training logs, per-epoch stats and early stopping ----------------------

@query
def q_training_log(spark, sf):
    from tagframe.operators import bag_of_words as B
    st = _tagged_splits(spark, sf, tagged=False)
    split = TB.split_of(F.col("doc_id"))
    return B.training_log(st.where(split == "train"), st.where(split == "valid"),
                          "text", "untagged", max_epochs=TB.LOG_EPOCHS)


@query
def q_epoch_stats(spark, sf):
    return W.epoch_stats(TB.epoch_logs(spark, sf))


@query
def q_early_stop(spark, sf):
    stats = W.epoch_stats(TB.epoch_logs(spark, sf))
    return W.early_stop(stats.withColumn("max_epochs", F.lit(TB.LOG_EPOCHS)), metric="eval_f1")
