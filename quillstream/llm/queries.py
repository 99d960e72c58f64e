"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm.bpe import op9
from quillstream.llm.collocations import OP12_SQL, op12
from quillstream.llm.common import read
from quillstream.llm.exact_dedup import OP4_SQL, op4
from quillstream.llm.html_text import op5
from quillstream.llm.jaccard_join import op3
from quillstream.llm.mixing import OP7_SQL, op7
from quillstream.llm.packing import op11
from quillstream.llm.prefix_trie import OP13_SQL, op13
from quillstream.llm.quality import op8
from quillstream.llm.secrets import op10
from quillstream.llm.topk_search import OP1_SQL, op1
from quillstream.llm.toxicity import op2
from quillstream.llm.url_filter import OP6_SQL, op6


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": lambda s, d: op1(read(s, d, "embeddings")),
        "op2_toxicity": lambda s, d: op2(read(s, d, "documents"), read(s, d, "labels")),
        "op3_jaccard_join": lambda s, d: op3(read(s, d, "documents")),
        "op4_exact_dedup": lambda s, d: op4(read(s, d, "documents")),
        "op5_html_text": lambda s, d: op5(read(s, d, "pages")),
        "op6_url_filter": lambda s, d: op6(read(s, d, "pages")),
        "op7_mix_sources": lambda s, d: op7(read(s, d, "documents")),
        "op8_quality": lambda s, d: op8(read(s, d, "documents"), read(s, d, "labels")),
        "op9_byte_bpe": lambda s, d: op9(read(s, d, "documents")),
        "op10_secret_scan": lambda s, d: op10(read(s, d, "documents")),
        "op11_best_fit_packing": lambda s, d: op11(read(s, d, "documents")),
        "op12_collocations": lambda s, d: op12(read(s, d, "documents")),
        "op13_prefix_trie": lambda s, d: op13(read(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_mix_sources": OP7_SQL,
        "op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL,
    }
