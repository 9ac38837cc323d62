"""Readers and writers of graph files: tab- or blank-separated text, dictionaries, vectors, phase tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.operators.storage import store


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def fields(spark: SparkSession, path: str, names: list[str], kind: str = "string", sep: str = "\t") -> DataFrame:
    """Columns ``names`` of a separated file (blanks: sep=r"\\s+"), with ``pos``, the line's place in the file.

    Lines with too few fields fail. ``pos`` orders lines as in the file; it has gaps between partitions."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    cut = lines.select("pos", F.split(F.trim("value"), sep).alias("f")).filter("size(f) > 1 or f[0] <> ''")
    short = F.size("f") < len(names)
    checked = cut.withColumn("f", F.when(short, F.raise_error(F.concat(F.lit("too few fields: "), F.array_join("f", "|"))).cast("array<string>")).otherwise(F.col("f")))
    return checked.select("pos", *[F.col("f")[i].cast(kind).alias(n) for i, n in enumerate(names)])


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path, ["s", "p", "o"])


def read_encoded_triples(spark: SparkSession, path: str, shift: int = 1) -> DataFrame:
    """Integer triples between blanks; the relation is shifted."""
    return fields(spark, path, ["h", "r", "t"], "long", r"\s+").withColumn("r", F.col("r") + shift)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path, ["src", "trg"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path, ["src", "trg"], "long", r"\s+")


def read_columns(spark: SparkSession, path: str, n: int) -> DataFrame:
    return fields(spark, path, [f"c{i}" for i in range(n)], "long", r"\s+")


def read_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id -> name over several files; a later line wins."""
    every = [fields(spark, p, ["id", "name"]).withColumn("file", F.lit(i)) for i, p in enumerate(paths)]
    rows = functools.reduce(DataFrame.unionByName, every)
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.max_by("name", F.struct("file", "pos")).alias("name"))


def first_of(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(paths)


def dictionary(*columns: DataFrame) -> DataFrame:
    """(key, pos) tables -> (key, id): dense numbers by first appearance.

    One aggregation finds the first place of each key; numbering needs a total order and so one sort
    of distinct keys, by range partitions, with each partition's size added up on the driver."""
    rows = functools.reduce(DataFrame.unionByName, columns)
    firsts = rows.groupBy("key").agg(F.min("pos").alias("pos"))
    return numbered(firsts, ["pos", "key"]).select("key", "id")


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Dense numbers from 0 in this order, without a window over all rows: rows are ranked within range
    buckets of the first order column, and each bucket gets the number of rows in those before. The rows are stored first, as they are read three times."""
    df = store(df)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(order[0], [i / n for i in range(1, n)], 0.01) if n > 1 and df.schema[order[0]].dataType.typeName() in ("long", "integer", "double") else []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + (F.col(order[0]) > F.lit(c)).cast("int")
    marked = df.withColumn("_b", F.coalesce(bucket, F.lit(-1)))
    sizes, base, rows = {r["_b"]: r["count"] for r in marked.groupBy("_b").count().collect()}, 0, []
    for b in sorted(sizes):
        rows.append((b, base))
        base += sizes[b]
    bases = df.sparkSession.createDataFrame(rows or [(0, 0)], "_b int, _base long")
    rank = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1
    return marked.withColumn("_r", rank).join(F.broadcast(bases), "_b").withColumn(name, (F.col("_base") + F.col("_r")).cast("long")).drop("_b", "_r", "_base")


def encode_graph(triples: DataFrame, links: DataFrame, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text triples and links -> (triples h, r, t; entity key, id; relation key, id). Entities that are only in links come last."""
    triples = store(triples)
    ends = store(dictionary(triples.select(F.col("s").alias("key"), (F.col("pos") * 2).alias("pos")), triples.select(F.col("o").alias("key"), (F.col("pos") * 2 + 1).alias("pos"))))
    unseen = links.select(F.col(side).alias("key"), "pos").join(ends, "key", "left_anti")
    size = ends.count()
    late = dictionary(unseen).withColumn("id", F.col("id") + F.lit(size))
    entity = store(ends.unionByName(late))
    relation = store(dictionary(triples.select(F.col("p").alias("key"), "pos")))
    h = entity.select(F.col("key").alias("s"), F.col("id").alias("h"))
    t = entity.select(F.col("key").alias("o"), F.col("id").alias("t"))
    r = relation.select(F.col("key").alias("p"), F.col("id").alias("r"))
    return triples.join(h, "s").join(t, "o").join(r, "p").select("h", "r", "t"), entity, relation


class Dataset:
    """Two graphs and their links. ``train_ratio`` of the links, from the first, are for training (none if unsupervised)."""

    def __init__(self, spark: SparkSession, triples: tuple[str, str], links: str, train_ratio: float = 0.2, shuffle_seed: int | None = None, unsupervised: bool = False):
        raw = [read_triples(spark, p) for p in triples]
        pairs = read_links(spark, links)
        (self.triples1, self.entity1, self.relation1), (self.triples2, self.entity2, self.relation2) = (encode_graph(t, pairs, side) for t, side in zip(raw, ("src", "trg"), strict=True))
        a = self.entity1.select(F.col("key").alias("src"), F.col("id").alias("a"))
        b = self.entity2.select(F.col("key").alias("trg"), F.col("id").alias("b"))
        linked = pairs.join(a, "src").join(b, "trg").select("pos", F.col("a").alias("src"), F.col("b").alias("trg"))
        self.links = store(split_links(linked, train_ratio, shuffle_seed, unsupervised))
        self.pseudo = spark.createDataFrame([], "src long, trg long")
        self.unsupervised = unsupervised

    TABLES = ("triples1", "entity1", "relation1", "triples2", "entity2", "relation2", "links", "pseudo")

    def save(self, path: str) -> None:
        """Every table as Parquet below ``path``."""
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dataset:
        """What ``save`` wrote."""
        made = cls.__new__(cls)
        for name in cls.TABLES:
            setattr(made, name, spark.read.parquet(f"{path}/{name}"))
        made.unsupervised = made.links.filter("is_train").isEmpty()
        return made

    @property
    def train(self) -> DataFrame:
        """Training links and pseudo-links; when unsupervised the latter alone."""
        return self.links.filter("is_train").select("src", "trg").unionByName(self.pseudo)

    @property
    def test(self) -> DataFrame:
        return self.links.filter("not is_train").select("src", "trg")


def split_links(links: DataFrame, train_ratio: float = 0.2, shuffle_seed: int | None = None, unsupervised: bool = False) -> DataFrame:
    """(pos, src, trg) -> is_train: the first int(ratio * n) by place, or by a seeded hash when shuffled."""
    ordered = links if shuffle_seed is None else links.withColumn("pos", F.xxhash64("src", "trg", F.lit(shuffle_seed)))
    ordered = store(ordered)
    cutoff = 0 if unsupervised else int(train_ratio * ordered.count())
    return numbered(ordered, ["pos", "src", "trg"], "place").select("src", "trg", "place", (F.col("place") < cutoff).alias("is_train"))


def paired_layout(spark: SparkSession, path: str, **options) -> Dataset:
    """rel_triples_1/2 (or triples_1/2) and ent_links in one folder."""
    pick = lambda i: first_of(spark, f"{path}/rel_triples_{i}", f"{path}/triples_{i}")
    return Dataset(spark, (pick(1), pick(2)), f"{path}/ent_links", **options)


def large_layout(spark: SparkSession, path: str, lang: str, strict: bool = False, **options) -> Dataset:
    """{lang}_triples[_strict]_1/2 and {lang}_ent_links."""
    mid = "_strict" if strict else ""
    return Dataset(spark, (f"{path}/{lang}_triples{mid}_1", f"{path}/{lang}_triples{mid}_2"), f"{path}/{lang}_ent_links", **options)


def write_delimited(df: DataFrame, path: str, order: list | None = None, sep: str = "\t", count: bool = False) -> None:
    """Text lines of the columns, sorted over all files if an order is given. ``count``: a first file, whose name sorts before the others',
    holds the number of lines, as a header."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)
    if count:
        head = f"{path}/_count"
        df.agg(F.count("*").cast("string").alias("value")).write.mode("overwrite").text(head)
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(head)
        fs = where.getFileSystem(conf)
        (part,) = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-0-count.txt"))
        fs.delete(where, True)


def keys_in_order(entity: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """A dictionary's keys by number: (id, key), sorted. ``remap`` (id, new): numbers are replaced, and keys without a new one go."""
    rows = entity if remap is None else entity.join(remap, "id").select(F.col("new").alias("id"), "key")
    return rows.select("id", "key").orderBy("id")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text (column value)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_dictionary(entity: DataFrame, path: str) -> None:
    """id, key lines by id."""
    write_delimited(entity.select("id", "key"), path, ["id"])


def write_empty(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def export_pair(data: Dataset, path: str) -> None:
    """Both graphs in one number space: the second graph's ids follow the first's, for entities and relations."""
    n, m = data.entity1.count(), data.relation1.count()
    shift = lambda df, by: df.withColumn("id", F.col("id") + by)
    for i, (e, r, t, de, dr) in enumerate(((data.entity1, data.relation1, data.triples1, 0, 0), (data.entity2, data.relation2, data.triples2, n, m)), 1):
        write_dictionary(shift(e, de), f"{path}/ent_ids_{i}")
        write_dictionary(shift(r, dr), f"{path}/rel_ids_{i}")
        write_delimited(t.select(F.col("h") + de, F.col("r") + dr, F.col("t") + de).toDF("h", "r", "t"), f"{path}/triples_{i}")
    write_delimited(data.links.select("src", (F.col("trg") + n).alias("trg")), f"{path}/ill_ent_ids")


def relation_ends(triples: DataFrame) -> DataFrame:
    """Each relation's distinct heads and tails."""
    return triples.groupBy("r").agg(F.sort_array(F.collect_set("h")).alias("heads"), F.sort_array(F.collect_set("t")).alias("tails"))


def write_vectors(df: DataFrame, path: str) -> None:
    """word and vector as a line of text with four decimals."""
    numbers = F.array_join(F.transform(F.col("vec"), lambda x: F.format_string("%.4f", x)), " ")
    df.select(F.concat_ws(" ", F.col("word"), numbers).alias("value")).write.mode("overwrite").text(path)


UNKNOWN = "**UNK**"


def read_vectors(spark: SparkSession, path: str, dim: int = 300) -> DataFrame:
    """word, vec of a text file of word vectors. Lines with another number of fields count as UNKNOWN (the last one stays);
    of repeated words the last stays too."""
    rows = spark.read.text(path).select(F.split(F.rtrim("value"), " ").alias("f"), F.monotonically_increasing_id().alias("pos"))
    whole = F.size("f") == dim + 1
    word = F.when(whole, F.col("f")[0]).otherwise(F.lit(UNKNOWN))
    vec = F.when(whole, F.slice("f", 2, dim)).cast("array<double>")
    return rows.select(word.alias("word"), vec.alias("vec"), "pos").groupBy("word").agg(F.max_by("vec", "pos").alias("vec"))


def look_up_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """word -> vec; words lose '#' and are lower-cased; a missing word has the vector of UNKNOWN, or null."""
    key = F.lower(F.regexp_replace("word", "#", ""))
    unknown = vectors.filter(F.col("word") == UNKNOWN).select(F.col("vec").alias("unknown")).limit(1)
    found = words.withColumn("key", key).join(vectors.withColumnRenamed("word", "key"), "key", "left")
    return found.join(F.broadcast(unknown), F.lit(True), "left").select("word", F.coalesce("vec", "unknown").alias("vec"))


def save_similarity(sim: DataFrame, base: str, phase: int, dataset: str, lang: str, side: str = "l2r") -> str:
    """A phase's similarity table, in a folder that names phase, dataset, language and side."""
    path = f"{base}/phase={phase}/dataset={dataset}/lang={lang}/side={side}"
    sim.write.mode("overwrite").parquet(path)
    return path


def load_similarities(spark: SparkSession, base: str, phases: list[int], dataset: str, lang: str, side: str = "l2r") -> list[DataFrame | None]:
    """The phases' tables; None for one that was not saved."""
    paths = [f"{base}/phase={p}/dataset={dataset}/lang={lang}/side={side}" for p in phases]
    return [spark.read.parquet(p) if exists(spark, p) else None for p in paths]


def log_metrics(spark: SparkSession, path: str, **values) -> None:
    """Append one row of names and values."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def read_attributes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(entity, attribute) of lines with an entity and any number of its attributes between tabs."""
    rows = spark.read.text(paths).select(F.split(F.trim("value"), "\t").alias("f")).filter("f[0] <> ''")
    return rows.select(F.col("f")[0].alias("entity"), F.explode(F.slice("f", 2, 1 << 20)).alias("attribute"))


def encoded_layout(spark: SparkSession, path: str, shift: int = 1) -> dict[str, DataFrame]:
    """A folder of encoded files: triples_1/2, and whichever is there of training and test pairs and of names."""
    out = {f"triples{i}": read_encoded_triples(spark, f"{path}/triples_{i}", shift) for i in (1, 2)}
    for name, files in (("train", ("sup_ent_ids", "ills_x2y")), ("test", ("ref_ent_ids", "test_ills_x2y", "ill_ent_ids"))):
        found = [f for f in files if exists(spark, f"{path}/{f}")]
        if found:
            out[name] = read_pairs(spark, f"{path}/{found[0]}")
    names = [f"{path}/ent_ids_{i}" for i in (1, 2) if exists(spark, f"{path}/ent_ids_{i}")]
    if names:
        out["names"] = read_names(spark, names)
    return out
