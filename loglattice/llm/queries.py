"""The queries of this package, by name."""

from . import conversation
from .bitplane import op1_bitplane
from .conversation import op13_conversations
from .lm import op6_lm
from .matroska import op5_matroska
from .minhash import op12_minhash
from .mixing import op2_mixing
from .packing import op8_packing
from .repetition import op9_repetition
from .simhash import op4_simhash
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op7_toxicity
from .whitening import op11_whitening
from .wordpiece import op10_wordpiece

QUERIES = {
    "op1_bitplane": op1_bitplane,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_matroska": op5_matroska,
    "op6_lm": op6_lm,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_repetition": op9_repetition,
    "op10_wordpiece": op10_wordpiece,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_conversations": op13_conversations,
}
ORACLES: dict[str, str] = {"op13_conversations": conversation.SQL}
