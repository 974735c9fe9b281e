"""Explicit schemas of the documented inputs; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

ARTICLE = _struct(id=_S, vbpl_id=_S, section_number=_S, section_content=_S)
LAW_LEVEL = _struct(id=_S, law_id=_S, law_name=_S, level=_struct(title=T.ArrayType(_S), scope=T.ArrayType(_S), article_title_list=T.ArrayType(_S), article_list=T.ArrayType(ARTICLE)))
_TREE_ARTICLE = _struct(id_Article=_S, title_Article=_S, content_Article=_S)
_TREE_SECTION = _struct(id_Section=_S, title_Section=_S, content_Section=T.ArrayType(_TREE_ARTICLE))
_TREE_CHAPTER = _struct(id_Chapter=_S, title_Chapter=_S, content_Chapter=T.ArrayType(_TREE_SECTION))
LAW_TREE = _struct(id=_S, law_name=_S, title=_S, scope=_S, content=T.ArrayType(_TREE_CHAPTER))
LAW_FLAT = _struct(id=_S, articles=T.ArrayType(_struct(id=_S, text=_S)))
LAW_PARAGRAPHS = _struct(id=_S, db_id=_S, paragraph=T.ArrayType(_S))
_LABEL = _struct(law_serial_number=_S, article_number=_S, article_name=_S, article_content=_S)
_PREDICTION = _struct(law_db_id=_S, article_db_id=_S, law_serial_number=_S, article_number=_S, score=_D)
QUESTION_MAIN = _struct(question_id=_L, text=_S, relevant_articles=T.ArrayType(_LABEL), predict_relevant_article=T.ArrayType(_PREDICTION))
QUESTION_LEGACY = _struct(id=_S, question=_S, relevant_laws=T.ArrayType(_struct(id_Law=_S, id_Chapter=_S, id_Section=_S, id_Article=_S)))
QUESTION_COMPETITION = _struct(question_id=_S, question_type=_S, text=_S, choices=T.MapType(_S, _S), relevant_articles=T.ArrayType(_struct(law_id=_S, article_id=_S)), answer=_S)
PREDICTIONS = _struct(question_id=_S, predict_relevant_articles=T.ArrayType(_struct(content=_S)))
MODEL_ANSWERS = _struct(question_id=_S, answer=_S)
PAIRS_SCORED = _struct(question=_S, article=_S, label=T.IntegerType(), bm25_score=_D, bert_score=_D)
PAIRS_BIENCODER = _struct(query=_S, article=_S, label=T.IntegerType())
PAIRS_SEQ2SEQ = _struct(question_list=_S, article_list=_S, bm25_score_list=_D, label_list=T.IntegerType())
ENSEMBLE = _struct(w_bm25=_D, w_bert=_D, threshold=T.IntegerType(), recall=_D)
