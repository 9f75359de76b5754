"""The query of each operator, and SQL where SQL can express it."""

from knotwork.llm import decontaminate, embedding, language, license, minhash, packing, quality, sharding, substring, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_license": license.op2_license,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_embedding": embedding.op5_embedding,
    "op6_packing": packing.op6_packing,
    "op7_substring": substring.op7_substring,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_minhash": minhash.op9_minhash,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL = {
    "op2_license": license.SQL,
    "op5_embedding": embedding.SQL,
    "op9_minhash": minhash.SQL,
}
