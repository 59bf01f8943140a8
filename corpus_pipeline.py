"""A corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.

An empty table passes through all stages and gives no rows. Texts are worked on whole. Rows that are
equal in all columns are judged alike until one of them is kept as a near duplicate.
"""

from regimespark.llm.common import new_path
from regimespark.llm.decontam import decontaminate
from regimespark.llm.langid import keep_identified
from regimespark.llm.minmax import drop_near_duplicates
from regimespark.llm.mixing import mixture as mixed
from regimespark.llm.mixing import with_mix_key
from regimespark.llm.tokens import tokenise


def language(spark, docs, sf_dir):
    """Documents whose language is not identified go (operator 6): those likelier in none than in any.

    A null or empty text is judged by its declared language and its source alone; null values of these are values of their own.
    """
    return keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (operator 7): five words a shingle, similarity 0.8.

    The smallest doc_id of a group stays, of equal ids one row; texts without words are linked with nothing and stay.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def benchmark(spark, docs, sf_dir):
    """Spans that match benchmark items are removed, and documents that mostly consist of them (operator 4).

    Null texts have no words and stay; n_chars follows the text where it is cut; items without words match nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    """Documents are replicated to the weights of their sources and shuffled (operator 9).

    A null source is a source of its own; copies have the columns of their document, so equal rows may follow.
    """
    return mixed(docs)


def token_files(spark, docs, sf_dir):
    """Token files in the shared folder, in the mixed order; their index is returned (operator 8).

    A null or empty text is the end id alone; copies have a row each.
    """
    return tokenise(with_mix_key(docs.select("doc_id", "text")), order="mix_key")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("token_files", token_files)]

#: SQL can express neither the trigram model nor the byte-pair encoding.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows, each stage written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
