"""Bibliographic items: record normalising, filters, collection paths, reading status, detail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.distribution import stored
from lexatlas.functions.text import literal

STATUSES = ("read", "reading", "to_read", "unknown")
#: Tags and collection paths, in lower case, that tell a reading status. Fixed values.
READ = ("read", "finished")
READING = ("reading", "current")
TO_READ = ("to read", "unread", "queue")

ITEM_SCHEMA = (
    "key string, version long, data struct<key:string,version:long,itemType:string,title:string,creators:array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,"
    "abstractNote:string,date:string,publicationTitle:string,DOI:string,url:string,tags:array<struct<tag:string,type:int>>,collections:array<string>,dateAdded:string,dateModified:string,extra:string>"
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def creator_name(creator: Column) -> Column:
    return F.coalesce(blank_to_null(creator["name"]), blank_to_null(F.concat_ws(" ", creator["firstName"], creator["lastName"])))


def normalise_items(records: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a JSON text column as items; fields that are blank become null, blank tags go."""
    item = records.select(F.from_json(column, ITEM_SCHEMA).alias("r")).select(F.coalesce("r.data.key", "r.key").alias("item_key"), F.coalesce("r.data.version", "r.version").alias("item_version"), "r.data.*")
    return item.select(
        "item_key", F.col("item_version").alias("version"), F.col("itemType").alias("item_type"), blank_to_null(F.col("title")).alias("title"),
        F.filter(F.transform(F.coalesce("creators", F.array().cast("array<struct<creatorType:string,firstName:string,lastName:string,name:string>>")), creator_name), lambda n: n.isNotNull()).alias("creators"),
        blank_to_null(F.col("abstractNote")).alias("abstract"), blank_to_null(F.col("date")).alias("date"), F.nullif(F.regexp_extract("date", r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)", 1), F.lit("")).alias("year"),
        blank_to_null(F.col("publicationTitle")).alias("publication"), blank_to_null(F.col("DOI")).alias("doi"), blank_to_null(F.col("url")).alias("url"),
        F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<struct<tag:string,type:int>>")), lambda t: F.trim(t["tag"])), lambda t: t != "")).alias("tags"),
        F.coalesce("collections", F.array().cast("array<string>")).alias("collections"), blank_to_null(F.col("extra")).alias("extra"),
    )


def filter_items(items: DataFrame, collection: str | None = None, tags: tuple[str, ...] = (), item_types: tuple[str, ...] = ()) -> DataFrame:
    """Items of any of the types (comma lists allowed), with all the tags, in the collection."""
    types = [t.strip() for x in item_types for t in x.split(",") if t.strip()]
    if types:
        items = items.where(F.col("item_type").isin(types))
    if tags:
        items = items.where(F.forall(literal(list(tags)), lambda t: F.array_contains(F.col("tags"), t)))
    return items.where(F.array_contains("collections", collection)) if collection else items


def matching(items: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    """Items by reading status and by words in title or abstract, without regard to case (% and _ are wildcards)."""
    if status:
        items = items.where(F.col("reading_status") == status)
    if q:
        pattern = f"%{q.lower()}%"
        items = items.where(F.lower("title").like(pattern) | F.lower("abstract").like(pattern))
    return items


def _doubled(rows: DataFrame, path: bool) -> DataFrame:
    """Every row joined with the one that it points to: its pointer goes twice as far, its path is that one's and its own."""
    own = rows.where("up is null")
    ahead = rows.select(F.col("key").alias("up"), F.col("up").alias("next"), *[F.col("path").alias("above")] * path)
    moved = rows.where("up is not null").join(ahead, "up")
    return own.unionByName(moved.select("key", F.col("next").alias("up"), *[F.concat("above", F.lit(" / "), "path").alias("path")] * path))


def collection_paths(collections: DataFrame) -> DataFrame:
    """key and path ('a / b / c') of trees of key (one row each), name, parent; a parent that is not there counts as none.

    Where the way up comes to a collection for the second time it ends there, with that one's key: 'a / B / A' for a cycle of
    two. Pointers double with every join, so a tree takes as many rounds as its depth has binary digits.
    """
    keys = collections.select(F.col("key").alias("parent"))
    start = collections.select("key", "name", "parent").join(keys.withColumn("there", F.lit(True)), "parent", "left")
    rows = stored(start.select("key", "name", F.when(F.col("there"), F.col("parent")).alias("up")), "collections")
    pointers, left = rows.select("key", "up"), rows.count()
    while left:
        if pointers.where("up is not null").isEmpty():
            return _paths(rows.select("key", "up", F.col("name").alias("path")))
        pointers, left = stored(_doubled(pointers, False), "pointers"), left // 2
    # pointers longer than any way without a repeat: they still point at the members of cycles, and at all of these
    members = pointers.where("up is not null").select(F.col("up").alias("key")).distinct()
    if members.isEmpty():
        return _paths(rows.select("key", "up", F.col("name").alias("path")))
    inside = stored(rows.join(members, "key", "left_semi"), "cycles")
    turned = _around(inside).withColumn("up", F.lit(None).cast(dict(rows.dtypes)["up"]))
    return _paths(rows.join(members, "key", "left_anti").select("key", "up", F.col("name").alias("path")).unionByName(turned))


def _paths(rows: DataFrame) -> DataFrame:
    """key and path of rows (key, up, path) whose pointers come to an end."""
    while not rows.where("up is not null").isEmpty():
        rows = stored(_doubled(rows, True), "paths")
    return rows.select("key", "path")


def _around(inside: DataFrame) -> DataFrame:
    """key and path of the members (key, name, up) of cycles: each goes around its own once, down from its key."""
    least = inside.select("key", "up", F.col("key").alias("first"))
    for _ in range(inside.count().bit_length()):
        ahead = least.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("first").alias("other"))
        least = stored(least.join(ahead, "up").select("key", F.col("next").alias("up"), F.least("first", "other").alias("first")), "first")
    led = inside.join(least.select("key", "first"), "key")
    # cut each cycle above its first key: places count from there down
    steps = stored(led.select("key", F.when(F.col("key") != F.col("first"), F.col("up")).alias("up"), F.when(F.col("key") != F.col("first"), 1).otherwise(0).alias("place")), "steps")
    while not steps.where("up is not null").isEmpty():
        ahead = steps.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        moved = steps.where("up is not null").join(ahead, "up").select("key", F.col("next").alias("up"), (F.col("place") + F.col("more")).alias("place"))
        steps = stored(steps.where("up is null").unionByName(moved), "steps")
    placed = led.select("key", "name", "first").join(steps.select("key", "place"), "key")
    names = placed.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("ring"))
    ring = F.transform("ring", lambda x: x["name"])
    down = F.concat(F.slice(ring, F.col("place") + 2, F.size("ring")), F.slice(ring, F.lit(1), F.col("place") + 1))
    return placed.join(names, "first").select("key", F.concat_ws(" / ", F.col("key").cast("string"), F.array_join(down, " / ")).alias("path"))


def resolve_collection(collections: DataFrame, ref: str) -> str:
    """The key that a reference names: a key, else an exact name or path, else one without regard to case. LookupError if none or several do."""
    named = collections.select("key", "name", "path")
    for rule in (F.col("key") == ref, (F.col("name") == ref) | (F.col("path") == ref), (F.lower("name") == ref.lower()) | (F.lower("path") == ref.lower())):
        found = [r.key for r in named.where(rule).select("key").distinct().limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise LookupError(f"{ref!r} names several collections")
    raise LookupError(f"no collection {ref!r}")


def reading_status(tags: Column, paths: Column, has_notes: Column) -> Column:
    """reading before to_read before read (or with notes) before unknown, from whole tags and collection paths."""
    marks = F.transform(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(paths, F.array().cast("array<string>"))), F.lower)
    has = lambda words: F.arrays_overlap(marks, literal(list(words)))
    return F.when(has(READING), "reading").when(has(TO_READ), "to_read").when(has(READ) | F.coalesce(has_notes, F.lit(False)), "read").otherwise("unknown")


def normalise_status(status: str | None) -> str | None:
    """A status of STATUSES, or of its old spelling with a hyphen; null for blank; ValueError for others."""
    if status is None or not status.strip():
        return None
    out = status.strip().lower().replace("-", "_")
    if out not in STATUSES:
        raise ValueError(f"no reading status {status!r}")
    return out


def weighted_text(title, abstract, tags, collections, notes, others) -> Column:
    """Title three times, abstract, tags, collections and notes twice, others once; blank fields dropped."""
    parts = [title] * 3 + [abstract] * 2 + [F.concat_ws(" ", tags)] * 2 + [F.concat_ws(" ", collections)] * 2 + [F.concat_ws("\n", notes)] * 2 + list(others)
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: F.trim(x) != ""), "\n")


def detail(items: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """items with an array column of rows for each child frame (which hold key), each gathered by itself and sorted."""
    for name, rows in children.items():
        gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        empty = F.array().cast(gathered.schema[name].dataType)
        items = items.join(gathered, key, "left").withColumn(name, F.coalesce(name, empty))
    return items


COLLECTION_SCHEMA = "key string, version long, data struct<key:string,version:long,name:string,parentCollection:string>"
CHILD_SCHEMA = "key string, version long, data struct<key:string,parentItem:string,itemType:string,note:string,annotationText:string,annotationComment:string,contentType:string,filename:string,path:string,linkMode:string>"
#: Attachment statuses that name a readable file. Fixed values.
RESOLVED = ("resolved", "linked_outside_data_dir")


def normalise_collections(records: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a JSON text column as collections; a parent that is false or blank is null."""
    c = records.select(F.from_json(column, COLLECTION_SCHEMA).alias("r"))
    return c.select(F.coalesce("r.data.key", "r.key").alias("key"), F.coalesce("r.data.version", "r.version").alias("version"), blank_to_null(F.col("r.data.name")).alias("name"), F.nullif(blank_to_null(F.col("r.data.parentCollection")), F.lit("false")).alias("parent"))


def normalise_children(records: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a JSON text column as notes, annotations and attachments of a parent item."""
    c = records.select(F.from_json(column, CHILD_SCHEMA).alias("r")).select(F.coalesce("r.data.key", "r.key").alias("child_key"), "r.data.*")
    return c.select(
        F.col("child_key").alias("key"), blank_to_null(F.col("parentItem")).alias("parent"), F.col("itemType").alias("kind"), blank_to_null(F.col("note")).alias("note"), blank_to_null(F.col("annotationText")).alias("annotation"),
        blank_to_null(F.col("annotationComment")).alias("comment"), blank_to_null(F.col("contentType")).alias("content_type"), blank_to_null(F.col("filename")).alias("filename"), blank_to_null(F.col("path")).alias("path"), blank_to_null(F.col("linkMode")).alias("link_mode"),
    )


def select_uri(key: Column) -> Column:
    """The link that opens an item in its program, for keys of eight or more capitals and digits."""
    return F.when(key.rlike("^[A-Z0-9]{8,}$"), F.concat(F.lit("zotero://select/items/"), key))


def is_pdf(content_type: Column, filename: Column, path: Column) -> Column:
    name = F.lower(F.coalesce(blank_to_null(filename), path, F.lit("")))
    return (F.lower(F.coalesce(content_type, F.lit(""))) == "application/pdf") | name.endswith(".pdf")


def library_prefix(value: str) -> str:
    """The one library that is supported, by any of its names; ValueError for others."""
    if value.strip().lower().lstrip("/") not in ("users/0", "user", "local"):
        raise ValueError("only the local user library is supported")
    return "/users/0"


def non_empty(values: tuple[str, ...], option: str) -> None:
    if any(not v.strip() for v in values):
        raise ValueError(f"{option} values must not be empty")


def resolve_attachments(attachments: DataFrame, files: DataFrame, data_dir: str | None = None) -> DataFrame:
    """attachments (attachment_key, path, filename) with candidate and path_status, by a listing of files that exist (path)."""
    path, name = F.coalesce("path", F.lit("")), F.coalesce("filename", F.lit(""))
    stored, absolute = path.startswith("storage:"), path.startswith("/")
    inner = F.coalesce(F.nullif(F.substring(path, 9, 1 << 30), F.lit("")), F.nullif(name, F.lit("")))
    base = data_dir.rstrip("/") if data_dir else ""
    in_storage = lambda n: F.concat_ws("/", F.lit(f"{base}/storage"), "attachment_key", n)
    candidate = F.when(absolute, path)
    if base:
        candidate = F.when(stored & inner.isNotNull(), in_storage(inner)).when(absolute, path).when(~stored & (path != ""), F.concat(F.lit(base + "/"), path)).when((path == "") & (name != ""), in_storage(name))
    found = attachments.withColumn("candidate", candidate).join(files.select(F.col("path").alias("candidate"), F.lit(True).alias("there")).distinct(), "candidate", "left")
    there = F.coalesce("there", F.lit(False))
    outside = absolute & ~F.col("candidate").startswith(base + "/") if base else F.lit(False)
    status = F.when((path == "") & (name == ""), "no_local_file").when(stored & F.lit(bool(base)) & inner.isNull(), "unsupported").when(F.col("candidate").isNotNull(), F.when(~there, "missing").when(outside, "linked_outside_data_dir").otherwise("resolved"))
    return found.select(*attachments.columns, "candidate", status.when((path == "") & F.lit(not base), "unsupported").otherwise("missing").alias("path_status"))


def attachment_counts(resolved: DataFrame) -> DataFrame:
    """One row: attachments seen, resolved, stored and linked."""
    path = F.coalesce("path", F.lit(""))
    return resolved.agg(F.count("*").alias("seen"), F.count_if(F.col("path_status").isin(*RESOLVED)).alias("resolved"), F.count_if(path.startswith("storage:")).alias("stored"), F.count_if((path != "") & ~path.startswith("storage:")).alias("linked"))


def sample_counters(parents: DataFrame, children: DataFrame, limit: int) -> DataFrame:
    """One row of counts over the children of a sample of parents: the `limit` with the least hashes of item_key.

    children: item_key, kind (attachment or another), content_type, filename, path, path_status, and error, not null where a
    parent's children could not be read: such rows count as failed and as nothing else.
    """
    sample = parents.select("item_key").distinct().orderBy(F.md5(F.col("item_key").cast("string")), "item_key").limit(max(0, limit))
    own = children.join(F.broadcast(sample), "item_key", "left_semi")  # at most `limit` keys
    read, path = F.col("error").isNull(), F.coalesce("path", F.lit(""))
    attached = read & (F.col("kind") == "attachment")
    pdf, good = is_pdf(F.col("content_type"), F.col("filename"), F.col("path")), F.coalesce(F.col("path_status").isin(*RESOLVED), F.lit(False))
    counts = {
        "children": read, "attachments": attached, "stored": attached & path.startswith("storage:"), "linked": attached & (path != "") & ~path.startswith("storage:"),
        "missing": attached & F.col("path_status").isin("missing", "no_local_file", "unsupported"), "linked_outside": attached & (F.col("path_status") == "linked_outside_data_dir"),
        "resolved_pdf": attached & pdf & good, "missing_pdf": attached & pdf & ~good,
    }
    return own.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.countDistinct(F.when(~read, F.col("item_key"))).alias("failed"))


def item_statistics(items: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: items, distinct linked documents, attachments, and those without a readable file."""
    unread = F.count_if(F.col("path_status").isin("missing", "no_local_file", "unsupported"))
    return (
        items.agg(F.count("*").alias("items"))
        .crossJoin(F.broadcast(links.agg(F.countDistinct("document_id").alias("documents"))))  # one row each
        .crossJoin(F.broadcast(attachments.agg(F.count("*").alias("attachments"), unread.alias("missing_attachments"))))
    )


def chosen_items(items: DataFrame, tags: DataFrame, memberships: DataFrame, collections: DataFrame, status: str | None = None, collection: str | None = None, tag: str | None = None, q: str | None = None) -> DataFrame:
    """Items by status, collection (key, or name or path without regard to case), tag and words; each filter is a semi-join, so no item comes twice."""
    out = matching(items, status, q)
    if collection:
        lower = collection.lower()
        wanted = collections.where((F.col("key") == collection) | (F.lower("name") == lower) | (F.lower("path") == lower)).select(F.col("key").alias("collection_key"))
        out = out.join(memberships.join(wanted, "collection_key", "left_semi").select("item_key"), "item_key", "left_semi")
    if tag:
        out = out.join(tags.where(F.col("tag") == tag).select("item_key"), "item_key", "left_semi")
    return out


def reading_documents(items: DataFrame, links: DataFrame, documents: DataFrame, texts: DataFrame, limit: int = 1000) -> DataFrame:
    """Active documents of items, with text, by the items' titles (ties: item, document)."""
    active = documents.where("status = 'active'").select("document_id", "relative_path")
    both = items.join(links.select("item_key", "document_id").distinct(), "item_key").join(active, "document_id")
    return both.join(texts.select("document_id"), "document_id", "left_semi").orderBy("title", "item_key", "document_id").limit(max(0, limit)).join(texts.select("document_id", "text"), "document_id")


def ascii_lower(text: Column) -> Column:
    """With A to Z in lower case and all other letters as they are: the order without regard to case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collections_of(memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """item_key and the paths (or names) of its collections, in order without regard to case."""
    shown = memberships.join(collections.select(F.col("key").alias("collection_key"), F.coalesce("path", "name").alias("shown")), "collection_key")
    return shown.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct(ascii_lower(F.col("shown")).alias("l"), "shown"))).alias("s")).select("item_key", F.transform("s", lambda x: x["shown"]).alias("paths"))


def links_of(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with their document's path and status, null where it is gone."""
    return links.join(documents.select("document_id", "relative_path", "status"), "document_id", "left")


def reading_meta(items: DataFrame, tags: DataFrame, memberships: DataFrame, collections: DataFrame, attachments: DataFrame) -> DataFrame:
    """item_key with tags, collections and attachment statuses as strings joined by '; ', and the first attachment's status."""
    folded = lambda rows, column: rows.groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ascii_lower(F.col(column)).alias("l"), F.col(column).alias("x")))), lambda s: s["x"]), "; ").alias(column))
    paths = collections_of(memberships, collections).select("item_key", F.array_join("paths", "; ").alias("collections"))
    files = attachments.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("attachment_key", "path_status"))).alias("s")).select("item_key", F.array_join(F.transform("s", lambda x: x["path_status"]), "; ").alias("attachment_status"), F.get("s", F.lit(0))["path_status"].alias("primary_attachment_status"))
    out = items.select("item_key").join(folded(tags, "tag").withColumnRenamed("tag", "tags"), "item_key", "left").join(paths, "item_key", "left").join(files, "item_key", "left")
    return out.fillna("", ["tags", "collections", "attachment_status"])


def import_items(items: DataFrame, known: DataFrame, min_chars: int = 80, metadata_only: bool = True, pdf_policy: str = "extract", force: bool = False) -> DataFrame:
    """items (item_key, text, has_pdf, pdf_resolved, pdf_text) against known documents (item_key, sha256): outcome and hash of each.

    outcome: skipped (short without metadata_only, or no PDF text under skip-missing), imported, unchanged or updated.
    """
    read = F.coalesce("pdf_text", F.lit("")) != ""
    skipped = ((F.length("text") < min_chars) & F.lit(not metadata_only)) | (F.lit(pdf_policy == "skip-missing") & F.col("has_pdf") & ~read)
    hashed = items.withColumn("sha256", F.sha2("text", 256)).join(known.select("item_key", F.col("sha256").alias("old")), "item_key", "left")
    outcome = F.when(skipped, "skipped").when(F.col("old").isNull(), "imported").when((F.col("old") == F.col("sha256")) & F.lit(not force), "unchanged").otherwise("updated")
    return hashed.withColumn("outcome", outcome).withColumn("metadata_only", ~skipped & ~read).drop("old")


def import_counters(outcomes: DataFrame, attachments: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of an import's counters; notes: item_key, kind (note or annotation)."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    read = F.coalesce("pdf_text", F.lit("")) != ""
    items = outcomes.agg(
        F.count("*").alias("items_seen"), of("imported").alias("items_imported"), of("updated").alias("items_updated"), of("unchanged").alias("items_unchanged"), of("skipped").alias("skipped"),
        F.count_if("has_pdf").alias("pdfs_seen"), F.count_if(F.col("has_pdf") & ~F.col("pdf_resolved")).alias("pdfs_missing"), F.count_if(F.col("has_pdf") & read).alias("pdfs_extracted"),
        F.count_if(F.col("has_pdf") & F.col("pdf_resolved") & ~read).alias("pdfs_extraction_failed"), F.count_if("metadata_only").alias("metadata_only_documents"),
    )
    files = attachment_counts(attachments).select(F.col("seen").alias("attachments_seen"), F.col("resolved").alias("attachments_resolved"), F.col("stored").alias("stored_attachments"), F.col("linked").alias("linked_attachments"))
    said = notes.agg(F.count_if(F.col("kind") == "note").alias("notes_imported"), F.count_if(F.col("kind") == "annotation").alias("annotations_imported"))
    return items.crossJoin(F.broadcast(files)).crossJoin(F.broadcast(said))  # one row each


def newest_version(items: DataFrame) -> DataFrame:
    """The cursor of the next import: the highest version, null without any."""
    return items.agg(F.max("version").alias("version"))


def import_library(items: DataFrame, known: DataFrame, attachments: DataFrame, notes: DataFrame, *, collection: str | None = None, tags: tuple[str, ...] = (), item_types: tuple[str, ...] = (), since: int | None = None, limit: int | None = None,
                   min_chars: int = 80, metadata_only: bool = True, pdf_policy: str = "extract", force: bool = False, dry_run: bool = False) -> dict[str, DataFrame]:
    """Import the items (item_key, version, item_type, tags, collections, text, has_pdf, pdf_resolved, pdf_text) that pass all filters.

    since: only items of a later version. Returns outcomes, counters and cursor (the version to go on from) and, unless it
    is a dry run, written: the items to upsert. ValueError for an unknown PDF policy.
    """
    if pdf_policy not in ("extract", "metadata", "skip-missing"):
        raise ValueError(f"no PDF policy {pdf_policy!r}")
    non_empty(tags, "tag")
    non_empty(item_types, "item type")
    chosen = filter_items(items, collection, tags, item_types)
    if since is not None:
        chosen = chosen.where(F.col("version") > since)
    if limit is not None:
        chosen = chosen.orderBy("item_key").limit(max(0, limit))
    if pdf_policy == "metadata":
        chosen = chosen.withColumn("pdf_text", F.lit(""))
    outcomes = import_items(chosen, known, min_chars, metadata_only, pdf_policy, force)
    mine = lambda rows: rows.join(chosen.select("item_key"), "item_key", "left_semi")
    out = {"outcomes": outcomes, "counters": import_counters(outcomes, mine(attachments), mine(notes)), "cursor": newest_version(items)}
    return out if dry_run else out | {"written": outcomes.where(F.col("outcome").isin("imported", "updated"))}
