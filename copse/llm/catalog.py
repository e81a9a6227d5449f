"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from copse.llm import linededup, merkle, mixing, packing, pieces, quality, repair, reputation, rules, sharding, simhash, topk, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_urls": reputation.op2_urls,
    "op3_simhash": simhash.op3_simhash,
    "op4_lines": linededup.op4_lines,
    "op5_shards": sharding.op5_shards,
    "shards_split": sharding.shards_split,
    "op6_mix": mixing.op6_mix,
    "op7_warc": warc.op7_warc,
    "op8_rules": rules.op8_rules,
    "op9_pack": packing.op9_pack,
    "op10_topk": topk.op10_topk,
    "op11_repair": repair.op11_repair,
    "op12_pieces": pieces.op12_pieces,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {
    "op2_urls": reputation.OP2_SQL,
    "op5_shards": sharding.OP5_SQL,
    "shards_split": sharding.SPLIT_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_rules": rules.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
    "op11_repair": repair.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
