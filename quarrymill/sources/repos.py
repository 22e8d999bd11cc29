"""Repository metadata: search results, lists to clone, and what there is to fetch."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrymill.functions.core import file_class, repo_name

RAW = """struct<id:bigint,name:string,full_name:string,html_url:string,clone_url:string,description:string,language:string,created_at:string,updated_at:string,size:bigint,
stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,license:struct<key:string>,topics:array<string>,owner:struct<login:string>,fork:boolean,archived:boolean>""".replace("\n", "")
RECORD = """struct<id:bigint,name:string,full_name:string,html_url:string,clone_url:string,description:string,language:string,created_at:string,updated_at:string,size:bigint,
stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,license:string,topics:array<string>,owner_login:string,is_fork:boolean,is_archived:boolean>""".replace("\n", "")


def project_metadata(raw: DataFrame) -> DataFrame:
    """The 18 fields of a search result's item, nested ones flattened, with defaults for text, topics and archived."""
    same = ["id", "name", "full_name", "html_url", "clone_url", "language", "created_at", "updated_at", "size", "stargazers_count", "forks_count", "open_issues_count"]
    return raw.select(
        *same, F.coalesce("description", F.lit("")).alias("description"), F.col("license.key").alias("license"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.col("owner.login").alias("owner_login"), F.col("fork").alias("is_fork"), F.coalesce("archived", F.lit(False)).alias("is_archived"),
    )


def parse_repo_list(text: DataFrame, column: str = "value") -> DataFrame:
    """Whole JSON documents, each a list of records or a map of them, to records that have a clone_url."""
    as_list = F.from_json(column, f"array<{RECORD}>")
    as_map = F.map_values(F.from_json(column, f"map<string,{RECORD}>"))
    is_list = F.ltrim(F.col(column)).startswith("[")
    return text.select(F.explode(F.when(is_list, as_list).otherwise(as_map)).alias("r")).select("r.*").where("clone_url IS NOT NULL")


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return parse_repo_list(spark.read.text(path, wholetext=True))


def to_fetch(repos: DataFrame, present: DataFrame, limit: int | None = None) -> DataFrame:
    """Repositories, most stars first, whose folder is not there yet."""
    named = repos.withColumn("repo", repo_name(F.col("clone_url")))
    left = named.join(present.select("repo"), "repo", "left_anti").orderBy(F.desc("stargazers_count"), "repo")
    return left.limit(limit) if limit is not None else left


def file_classes(paths: DataFrame, shown: int = 20, path: str = "path") -> DataFrame:
    """class (git, kept, other), n, examples: how many paths each class has, and the first ones."""
    rows = paths.select(F.col(path).alias("path"), file_class(F.col(path)).alias("class"))
    place = F.row_number().over(W.partitionBy("class").orderBy("path"))
    first = rows.withColumn("_r", place).where(F.col("_r") <= shown).groupBy("class").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(first, "class")


def clone_all(urls: list[str], folder: str, depth: int = 10, run: Callable = subprocess.run) -> list[str]:
    """Shallow clones, skipping what is there; an action of the driver. Returns the folders."""
    import os

    out = []
    for url in urls:
        target = os.path.join(folder, url.rstrip("/").split("/")[-1].replace(".git", ""))
        if not os.path.isdir(target):
            run(["git", "clone", "--depth", str(depth), url, target], check=False)
        out.append(target)
    return out


def rate_gate(remaining: int, reset: float, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Waits until ten seconds past the reset if fewer than ten calls remain. Did it wait?"""
    if remaining >= 10:
        return False
    sleep(max(0.0, reset - now()) + 10)
    return True


class _Page(InputPartition):
    def __init__(self, language: str, page: int):
        super().__init__(0)
        self.language, self.page = language, page


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda name, default: [x.strip() for x in options.get(name, default).split(",") if x.strip()]
        self.languages, self.topics = split("languages", "python,java,cpp"), split("topics", "")
        self.pages, self.base = int(options.get("pages", "100")), options["endpoint"].rstrip("/")
        self.query = " ".join([f"stars:>{options.get('minStars', options.get('minstars', '50'))}", f"size:<{options.get('maxSize', options.get('maxsize', '100000'))}", *[f"topic:{t}" for t in self.topics]])
        self.token = options.get("token", "")

    def partitions(self) -> list[InputPartition]:
        return [_Page(x, p) for x in self.languages for p in range(self.pages)]

    def _get(self, path: str) -> dict:
        import json
        from urllib.request import Request, urlopen

        with urlopen(Request(self.base + path, headers={"Authorization": f"token {self.token}"} if self.token else {}), timeout=60) as reply:
            return json.load(reply)

    def may_search(self) -> bool:
        """False where the gate had to wait: the page is left out then. A limit that cannot be read is no reason to wait."""
        try:
            core = self._get("/rate_limit")["resources"]["core"]
        except (OSError, ValueError, KeyError):
            return True
        return not rate_gate(core["remaining"], core["reset"])

    def read(self, partition: _Page) -> Iterator[tuple]:
        import json
        from urllib.parse import urlencode

        if not self.may_search():
            return
        query = urlencode({"q": f"language:{partition.language} {self.query}", "sort": "stars", "order": "desc", "per_page": 100, "page": partition.page})
        for item in self._get(f"/search/repositories?{query}").get("items", []):
            yield (json.dumps(item),)


class RepositorySearch(DataSource):
    """format("repository_search"): one partition for each language and page, behind the rate gate. Options endpoint,
    languages, topics, pages, minStars, maxSize, token. Column value holds an item's JSON; see project_metadata."""

    @classmethod
    def name(cls) -> str:
        return "repository_search"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SearchReader(dict(self.options))


def items(found: DataFrame, column: str = "value") -> DataFrame:
    return project_metadata(found.select(F.from_json(column, RAW).alias("r")).select("r.*"))


def is_git(name: Column) -> Column:
    return name.startswith(".git")
