"""End-to-end runs: select, read, process, order, write."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.config import Processing, Rendering, Selection
from folioloom.functions import text as T
from folioloom.operators.content import process_content
from folioloom.operators.documents import document_rows, dry_run_rows
from folioloom.operators.ignore import PreparedRules, Rule, drop_ignored
from folioloom.operators.order import sort_files
from folioloom.operators.select import glob_ignored, in_vcs_folder, select_files, wants_vcs_folder
from folioloom.operators.skew import stored
from folioloom.session import mounted_path
from folioloom.sinks.documents import iterate_document, write_document
from folioloom.sources.descent import list_unignored
from folioloom.sources.files import list_files, read_contents
from folioloom.sources.rules import outer_rules


@dataclass(frozen=True)
class Digest:
    """Options of a run.

    `discover` with a list of rules, `process` and `execute` are lazy. A rule table, an order, a document or a tree needs passes over paths
    first, so those methods run jobs and store narrow tables; `document` stores the processed rows. `scope` names the columns of a corpus
    of many repositories that rules belong to, `group` those that each have a document of their own, `ties` those that tell copies
    of one path apart.
    """

    selection: Selection = field(default_factory=Selection)
    processing: Processing = field(default_factory=Processing)
    rendering: Rendering = field(default_factory=Rendering)

    def discover(self, corpus: DataFrame, rules: Sequence[Rule] | DataFrame | PreparedRules | None = None,
                 scope: Sequence[str] = (), root: str | None = None) -> DataFrame:
        """Selected and tagged rows; with `rules` the ignore rules apply unless they are switched off."""
        chosen = select_files(corpus, self.selection, root)
        if rules is None or not self.selection.use_ignore_rules:
            return chosen
        return drop_ignored(chosen, rules, scope, self.selection.last)

    def process(self, discovered: DataFrame) -> DataFrame:
        return process_content(discovered, self.processing)

    def execute(self, corpus: DataFrame, rules: Sequence[Rule] | DataFrame | PreparedRules | None = None,
                scope: Sequence[str] = ()) -> DataFrame:
        """Processed rows of a content table, unordered."""
        return self.process(self.discover(corpus, rules, scope))

    def ordered(self, corpus: DataFrame, rules=None, scope: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
        """Processed rows in document order: partition after partition, row after row."""
        found = self.discover(corpus, rules, scope)
        return sort_files(self.process(found), ties, keys=found)

    def document(self, corpus: DataFrame, rules=None, scope: Sequence[str] = (), group: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
        """`(group..., position, text)` of the Markdown document, or of one per group.

        Numbers need to know which rows the content tests leave, so processed rows are stored and content is evaluated once.
        """
        return document_rows(stored(self.execute(corpus, rules, scope), "processed"), self.rendering, group, ties)

    def dry_run(self, corpus: DataFrame, rules=None, exact: bool = False, scope: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
        """`(position, text)` of the files a run would take, judged by their first 1024 bytes.

        `exact=True` judges whole contents, as the run itself does.
        """
        return dry_run_rows(self.dry_run_files(corpus, rules, exact, scope), self.rendering, ties)

    def dry_run_files(self, corpus: DataFrame, rules=None, exact: bool = False, scope: Sequence[str] = ()) -> DataFrame:
        found = self.discover(corpus, rules, scope)
        if self.processing.include_binary:
            return found
        test = T.is_text if exact else T.is_text_head
        return found.where(test(F.col("content")))

    def write(self, corpus: DataFrame, folder: str, rules=None, scope: Sequence[str] = (), ties: Sequence[str] = ()) -> int:
        """Write the document of a content table; returns the number of files."""
        found = self.discover(corpus, rules, scope)
        return write_document(self.process(found), folder, self.rendering, keys=found, ties=ties)

    def iterate(self, corpus: DataFrame, rules=None, scope: Sequence[str] = (), ties: Sequence[str] = ()) -> Iterator[str]:
        """The document of a content table piece by piece, to be printed; the driver holds some megabytes of it at a time."""
        found = self.discover(corpus, rules, scope)
        return iterate_document(self.process(found), self.rendering, keys=found, ties=ties)

    # ------------------------------------------------------------- file trees

    def discover_tree(self, spark: SparkSession, root: str) -> DataFrame:
        """Listing of the selected files below `root`. Ignored and pruned folders are never entered, contents not yet read.

        The rules come from the ignore files of the tree, as they are met, its exclude file, ignore files above it and the user's global one.
        """
        sel = self.selection
        if os.path.isfile(mounted_path(root)):  # a file named outright is subject to the metadata predicates only
            named = Digest(replace(sel, ignore_globs=None, use_ignore_rules=False), self.processing, self.rendering)
            return named.discover(list_files(spark, root), root=root)

        def prune(path):
            skip = glob_ignored(path, sel.ignore_globs) if sel.ignore_globs else F.lit(False)
            return skip if wants_vcs_folder(root, sel.last, sel.path_regex) else skip | in_vcs_folder(path)

        if sel.use_ignore_rules:
            listing = list_unignored(spark, root, sel.recursive, prune, outer_rules(os.path.abspath(mounted_path(root))), sel.last)
        else:
            listing = list_files(spark, root, sel.recursive, prune)
        # An entry that cannot be listed is skipped whatever the options are; only files that were chosen may fail a run.
        failed = listing.where("error is not null").count()
        if failed:
            warnings.warn(f"{failed} entries below {root} could not be listed", stacklevel=2)
        return self.discover(listing.where("error is null"), root=root)

    def execute_tree(self, spark: SparkSession, root: str, on_error: str = "fail") -> DataFrame:
        """Processed rows of a tree. Unreadable files fail the run, or with `"keep"` are left to `split_errors`."""
        contents = read_contents(self.discover_tree(spark, root), on_error=on_error)
        if on_error == "keep":
            return process_content(contents.where("error is null").drop("error"), self.processing)
        return process_content(contents.drop("error"), self.processing)

    def dry_run_tree(self, spark: SparkSession, root: str) -> DataFrame:
        """As `dry_run`; reads 1 KiB per file and leaves unreadable files out."""
        found = self.discover_tree(spark, root)
        if not self.processing.include_binary:
            heads = read_contents(found, head_bytes=T.HEAD_BYTES, on_error="keep")
            found = heads.where("error is null").where(T.is_text(F.col("content"))).drop("content", "error")
        return dry_run_rows(found, self.rendering)

    def write_tree(self, spark: SparkSession, root: str, folder: str) -> int:
        found = self.discover_tree(spark, root)
        processed = process_content(read_contents(found).drop("error"), self.processing)
        return write_document(processed, folder, self.rendering, keys=found)
