"""Full-text search and ranking on Apache Spark."""

from lodestone.document import Document, Field, Term
from lodestone.errors import Corrupt, IllegalArgument, IndexNotFound, LockObtainFailed, LodestoneError, QueryParse, StorageError
from lodestone.functions.analysis import FunctionAnalyzer, KeywordAnalyzer, PatternAnalyzer, PerFieldAnalyzer, SimpleAnalyzer, StandardAnalyzer, WhitespaceAnalyzer, tokenize
from lodestone.plans.parser import Operator, QueryParser
from lodestone.plans.query import Boost, BooleanQuery, ConstantScore, F64Range, I64Range, MatchAll, MatchNone, Occur, PhraseQuery, Query, TermQuery
from lodestone.reader import IndexReader
from lodestone.schema import DocValues, FieldSpec, IndexOptions, IndexSchema
from lodestone.searcher import BY_SCORE, FieldDoc, IndexSearcher, Missing, Order, ScoreDoc, SortField, TopDocs, TotalHits
from lodestone.writer import IndexWriter, MergePolicy, WriterConfig

__all__ = [n for n in dir() if n[0].isupper()] + ["tokenize"]
