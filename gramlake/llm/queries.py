"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from gramlake.llm.chat import OP9_SQL, op9_query
from gramlake.llm.divergence import OP11_SQL, op11_query
from gramlake.llm.exact_dedup import OP3_SQL, op3_query
from gramlake.llm.mixing import op6_query
from gramlake.llm.paragraphs import op8_query
from gramlake.llm.periodic import OP12_SQL, op12_query
from gramlake.llm.pieces import op7_query
from gramlake.llm.quality import op5_query
from gramlake.llm.rules import OP13_SQL, op13_query
from gramlake.llm.simhash import op4_query
from gramlake.llm.substring import op10_query
from gramlake.llm.topk import OP1_SQL, op1_query
from gramlake.llm.warc import OP2_SQL, op2_query

QUERIES = {
    "op1_topk": op1_query,
    "op2_warc": op2_query,
    "op3_exact_dedup": op3_query,
    "op4_simhash": op4_query,
    "op5_quality": op5_query,
    "op6_mixing": op6_query,
    "op7_sentencepiece": op7_query,
    "op8_paragraphs": op8_query,
    "op9_chat": op9_query,
    "op10_substring": op10_query,
    "op11_divergence": op11_query,
    "op12_periodic": op12_query,
    "op13_rules": op13_query,
}
ORACLES = {"op1_topk": OP1_SQL, "op2_warc": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op9_chat": OP9_SQL, "op11_divergence": OP11_SQL, "op12_periodic": OP12_SQL, "op13_rules": OP13_SQL}
