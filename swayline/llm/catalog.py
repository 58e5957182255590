"""The dealt queries, one per operator, and their SQL where SQL can express them."""

from swayline.llm import conversation_repair, license_scan, spelling, sql, vector_dedup
from swayline.llm.chat_format import op2_chat_format
from swayline.llm.conversation_repair import op13_conversation_repair
from swayline.llm.decontaminate import op5_decontaminate
from swayline.llm.fingerprint import op9_fingerprint
from swayline.llm.language_id import op4_language_id
from swayline.llm.license_scan import op10_license_scan
from swayline.llm.lm_score import op7_lm_score
from swayline.llm.minhash import op8_minhash
from swayline.llm.packing import op6_packing
from swayline.llm.spelling import op11_spelling_variants
from swayline.llm.substring_dedup import op1_substring_dedup
from swayline.llm.suffix_dedup import op3_suffix_dedup
from swayline.llm.vector_dedup import op12_vector_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_minhash": op8_minhash,
    "op9_fingerprint": op9_fingerprint,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op1_substring_dedup": sql.SUBSTRING,
    "op2_chat_format": sql.CHAT,
    "op3_suffix_dedup": sql.SUFFIX,
    "op8_minhash": sql.MINHASH,
    "op10_license_scan": license_scan.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_vector_dedup": vector_dedup.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
