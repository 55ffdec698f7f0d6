"""The registered queries of this subpackage and their DuckDB SQL."""

from .decontaminate import OP8_SQL, op8_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op4_html_text
from .lm import op6_lm_score
from .long_repeats import op9_long_repeats
from .near_dedup import OP2_SQL, op2_near_dedup
from .passages import op3_shared_passages
from .pieces import op7_sentencepiece
from .quality import op5_quality
from .token_files import op1_token_file

QUERIES = {f.__name__: f for f in (op1_token_file, op2_near_dedup, op3_shared_passages, op4_html_text, op5_quality, op6_lm_score, op7_sentencepiece, op8_decontaminate, op9_long_repeats, op10_exact_dedup)}
ORACLES = {"op2_near_dedup": OP2_SQL, "op8_decontaminate": OP8_SQL, "op10_exact_dedup": OP10_SQL}
