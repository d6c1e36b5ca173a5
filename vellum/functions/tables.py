"""Table functions: the nodes of a text, the blocks of a Markdown text. register_tables publishes them to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.markdown import scan
from ..operators.structure import Line, structure


class StructureNodes:
    """node_id, tipo, rotulo, char_start, char_end, pai of a plain text's structure; a null text has none."""

    def eval(self, text: str, subtype: str):
        if text is not None:
            for n in structure((Line(x, False) for x in text.split("\n")), subtype or "desconhecido")[0]:
                yield n.node_id, n.tipo, n.rotulo, n.char_start, n.char_end, n.pai


class MarkdownBlocks:
    """kind, depth, first and last line (from 1) and text of a Markdown text's blocks; a null text has none."""

    def eval(self, text: str):
        if text is not None:
            for b in scan(text.splitlines()):
                yield b.kind, b.depth, b.start + 1, b.end, b.text


structure_nodes = udtf(StructureNodes, returnType="node_id string, tipo string, rotulo string, char_start int, char_end int, pai string")
markdown_blocks = udtf(MarkdownBlocks, returnType="kind string, depth int, first int, last int, text string")


def register_tables(spark: SparkSession) -> list[str]:
    """Publishes structure_nodes(text, subtype) and markdown_blocks(text), for FROM and LATERAL."""
    spark.udtf.register("structure_nodes", structure_nodes)
    spark.udtf.register("markdown_blocks", markdown_blocks)
    return ["structure_nodes", "markdown_blocks"]
