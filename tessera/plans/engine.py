"""The engine's facade: a knowledge base in versioned tables, and plans over sets of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import agents, answers, chunking, extraction, graph, live, logs, ranking
from ..operators.embedders import HashEmbedder
from ..sources.files import read_folder
from ..sources.graph_store import GraphStore, View
from ..sources.scratch import stored
from ..sources.tables import VersionedTable
from .rounds import Outcome, Worker, ask_in_rounds

CHUNKS = "seq long, doc_id string, chunk_index int, char_len int, content string"
ACTIONS = "action_id string, action string, order_id string, field string, value string, amount double, subject string, priority string, confirmed boolean, customer string, sku string, ticket_id string, status string, error string, seq long"
AUDIT = "query_id long, question string, score double, confidence string, guardrail string, rounds int, declined array<string>, delegated boolean, pending_human boolean, failed string, ts string"
POSTINGS = "seq long, term string, tf long, dl int"
VECTORS = "seq long, idx int, weight double, dim int"


class KnowledgeBase:
    """Chunks with their postings and embeddings, graph and action log under one folder. Every method that answers takes a table of
    questions (query_id, query, order_id, sku) and returns a DataFrame."""

    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark, self.path, self.embedder = spark, path, embedder
        self.chunks = VersionedTable(spark, f"{path}/chunks", CHUNKS)
        self.postings = VersionedTable(spark, f"{path}/postings", POSTINGS)
        self.vectors = VersionedTable(spark, f"{path}/vectors", VECTORS)
        self.graph = GraphStore(spark, f"{path}/graph")
        self.nodes, self.edges = View(self.graph.nodes), View(self.graph.edges_with_docs)
        self.actions = VersionedTable(spark, f"{path}/actions", ACTIONS)

    def ping(self) -> str:
        return "pong"

    # ------------------------------------------------------------ documents

    def ingest(self, docs: DataFrame, strategy: str = "fine", batch: str | None = None) -> int:
        """Add documents (doc_id, text): their chunks, and the triples they state; returns how many
        chunks were added. Ingesting a document again adds its chunks again, as in an append-only
        store. A named ``batch`` can be given again after a failure: what it had added already
        stays as it is, and the rest is added. Chunks come last of what a search reads."""
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        before = self.chunks.count()
        # the same document ingested again has chunks of its own
        seq = F.xxhash64("doc_id", "chunk_index", "content", F.lit(before if batch is None else batch))
        made = chunking.chunk(docs, strategy=strategy).select(seq.alias("seq"), "doc_id", "chunk_index", "char_len", "content")
        # all is made, and each text read once by each step, before any table changes
        made = stored(made, "chunks")
        tf = stored(ranking.term_frequencies(made, "seq", "content").select("seq", "term", "tf", "dl"), "postings")
        vectors = stored(self._embedded(made, tf), "vectors")
        triples = stored(extraction.extract_triples(docs), "triples")
        for table, rows in ((self.postings, tf), (self.vectors, vectors), (self.chunks, made)):
            table.append(rows if batch is None else rows.join(table.read().select("seq").distinct(), "seq", "left_anti").select(rows.columns))
        self.add_triples(triples)
        return self.chunks.count() - before

    def dimension(self) -> int:
        """The number of slots of the stored embeddings."""
        row = self.vectors.read().select("dim").first()
        return row.dim if row else ranking.DIM

    def _embedder(self):
        return self.embedder or HashEmbedder(self.dimension())

    def _embedded(self, chunks: DataFrame, postings: DataFrame) -> DataFrame:
        own = self._embedder()
        return own.embed(chunks, "seq", "content", postings if own.from_postings else None).withColumn("dim", F.lit(own.dim))

    def reembed(self, by) -> int:
        """Embed all chunks anew, by an embedder or by the hash embedder with so many slots, from
        their postings where it can; returns their number. Searches use it from then on."""
        self.embedder = HashEmbedder(by) if isinstance(by, int) else by
        self.vectors.replace(self._embedded(self.chunks.read(), self.postings.read()))
        return self.chunks.count()

    def ingest_folder(self, path: str, prefix: str = "") -> DataFrame:
        """Ingest all readable files under a folder; returns those that failed."""
        docs, failed = read_folder(self.spark, path, prefix)
        self.ingest(docs)
        return failed

    def add_triples(self, triples: DataFrame) -> dict[str, int]:
        """Write triples (subject_type, subject, rel, object_type, object, doc_id, seq and, if
        there, props). Their seq counts on from the graph's last, so the latest batch is the
        newest. Returns how many edges were added, how many valid triples were known already
        (skipped) and how many the ontology forbids (invalid)."""
        schema = graph.relation_schema(self.spark)
        last = self.graph.last_seq()
        triples = stored(triples, "triples")
        ok = stored(graph.valid_triples(triples, schema).withColumn("seq", F.col("seq") + (0 if last is None else last + 1)), "valid")
        made = stored(ok.select(graph.node_key(F.col("subject_type"), F.col("subject")).alias("src"), "rel", graph.node_key(F.col("object_type"), F.col("object")).alias("dst")).distinct(), "edges")
        added = made.count() - self.graph.known(made).count()
        total, valid = triples.count(), ok.count()
        self.graph.upsert_triples(ok)
        return {"added": added, "skipped": valid - added, "invalid": total - valid}

    def clear_graph(self) -> None:
        self.graph.clear()

    def rebuild_graph(self) -> DataFrame:
        """The graph made anew from all chunks; returns its statistics."""
        self.clear_graph()
        self.add_triples(extraction.extract_triples(chunking.document_text(self.chunks.read())))
        return self.graph_stats()

    def update_graph(self) -> None:
        """Add what documents without a Document node state."""
        texts = chunking.document_text(self.chunks.read())
        self.add_triples(extraction.extract_triples(graph.unseen_documents(texts, self.graph.nodes())))

    def documents(self) -> DataFrame:
        return chunking.document_list(self.chunks.read())

    def delete_document(self, doc_id: str) -> int:
        """Remove a document's chunks and what only it states; returns the number of chunks."""
        self.graph.delete_documents(self.spark.createDataFrame([(doc_id,)], "doc_id string"))
        gone = self.chunks.read().where(F.col("doc_id") == doc_id).select("seq")
        for table in (self.postings, self.vectors):
            table.replace(table.read().join(gone, "seq", "left_anti"))
        return self.chunks.delete(F.col("doc_id") == doc_id)

    # ------------------------------------------------------------ questions

    def search(self, questions: DataFrame, top_k: int = 5, mode: str = "hybrid", min_score: float = 0.0, lam: float | None = 0.6, rerank=None) -> DataFrame:
        """query_id, rank, score, source, doc_id, chunk_index, content, from the stored postings and
        embeddings; ``lam`` (none: off) and ``rerank`` as in ``ranking.hybrid_search``."""
        chunks = self.chunks.read()
        own = chunks.select(F.col("seq").alias("id"), F.col("content").alias("text"))
        have = self.postings.read().withColumnRenamed("seq", "id"), self.vectors.read().select(F.col("seq").alias("id"), "idx", "weight")
        asked = questions.select("query_id", "query")
        hits = ranking.hybrid_search(own, asked, top_k, mode, min_score, lam=lam, rerank=rerank, postings=have[0], embeddings=have[1], embedder=self._embedder())
        return hits.join(chunks, F.col("id") == F.col("seq")).select("query_id", "rank", "score", "source", "doc_id", "chunk_index", "content")

    def graph_stats(self) -> DataFrame:
        return graph.stats(self.graph.nodes(), self.graph.edges())

    def graph_entities(self, part: str = "", kind: str | None = None, limit: int = 20) -> DataFrame:
        return graph.find_entities(self.graph.nodes(), self.graph.edges(), part, kind, limit)

    def graph_query(self, names: DataFrame, depth: int = 1, direction: str = "out", rel: str | None = None, limit: int = 20) -> DataFrame:
        return graph.neighbours(graph.resolve(names, self.graph.nodes()), self.graph.edges(), depth, direction, rel, limit)

    def graph_paths(self, pairs: DataFrame, depth: int = 3, limit: int = 10) -> DataFrame:
        return graph.simple_paths(pairs, self.graph.edges(), depth, limit)

    def graph_expand(self, questions: DataFrame, depth: int = 2, limit: int = 12) -> DataFrame:
        return graph.expand_facts(extraction.query_entities(questions), self.graph.nodes(), self.graph.edges(), depth, limit)

    def graph_export(self) -> tuple[DataFrame, DataFrame]:
        return graph.export(self.graph.nodes(), self.graph.edges())

    def ask(self, questions: DataFrame, orders: DataFrame, stock: DataFrame, failures: DataFrame | None = None, top_k: int = 5) -> DataFrame:
        """query_id, summary, answer, score, confidence, n_facts, guardrail, missing of each
        question: hits, facts and live cards are independent branches of one plan."""
        of = lambda df, channel: df.select("query_id", F.lit(channel).alias("channel"), "place", "item", "score")
        evidence = of(self.hit_evidence(questions, top_k), "hits").unionByName(of(self.fact_evidence(questions), "facts")).unionByName(of(self.live_evidence(questions, orders, stock, failures), "live"))
        tried = questions.select("query_id", F.array(F.lit("retrieval"), F.lit("graph")).alias("done"), F.array().cast("array<string>").alias("declined"))
        return self._answers(questions, evidence, tried).select("query_id", "summary", "answer", "score", "confidence", "n_facts", "guardrail", "missing")

    def hit_evidence(self, questions: DataFrame, top_k: int = 5, **search) -> DataFrame:
        """query_id, place, item, score of what the search finds."""
        return self.search(questions, top_k, **search).select("query_id", F.col("rank").cast("int").alias("place"), F.col("content").alias("item"), "score")

    def fact_evidence(self, questions: DataFrame) -> DataFrame:
        """query_id, place, item, score (null): paths in the graph near a question's entities."""
        found = self.graph_expand(questions.select("query_id", "query"))
        own = F.col("query_id").cast(dict(questions.dtypes)["query_id"]).alias("query_id")
        return found.select(own, F.col("rank").cast("int").alias("place"), F.col("path").alias("item"), F.lit(None).cast("double").alias("score"))

    def live_evidence(self, questions: DataFrame, orders: DataFrame, stock: DataFrame, failures: DataFrame | None = None) -> DataFrame:
        """query_id, place, item, score (null): lines of order and stock cards, and what to ask for
        where a question wants live data but names no id."""
        failures = failures if failures is not None else self.spark.createDataFrame([], "order_id string, error string, attempts int")
        blank = F.lit(None).cast("string")
        found = live.lookup(questions.select("query_id", "order_id"), orders, failures, "order_id").where("outcome <> 'not_asked'")
        card = F.struct(
            F.when(F.col("outcome") == "found", "order").when(F.col("outcome") == "unavailable", "degraded").otherwise("not_found").alias("type"),
            F.lit("order_status").alias("adapter"), "order_id", blank.alias("sku"), "status", "carrier", "eta", blank.alias("stock"), blank.alias("warehouse"), "error",
            "attempts", F.lit(False).alias("short_circuited"), F.lit(False).alias("non_retryable"), blank.alias("note"),
        )
        cards = found.select("query_id", F.lit(0).alias("place"), answers.live_line(card).alias("item"))
        items = live.lookup(questions.select("query_id", "sku"), stock, failures.select(F.col("order_id").alias("sku"), "error", "attempts").limit(0), "sku").where("outcome <> 'not_asked'")
        item = F.struct(
            F.when(F.col("outcome") == "found", "inventory").otherwise("not_found").alias("type"), F.lit("inventory").alias("adapter"), blank.alias("order_id"), "sku",
            blank.alias("status"), blank.alias("carrier"), blank.alias("eta"), F.col("stock").cast("string").alias("stock"), "warehouse", "error", "attempts",
            F.lit(False).alias("short_circuited"), F.lit(False).alias("non_retryable"), blank.alias("note"),
        )
        cards = cards.union(items.select("query_id", F.lit(1), answers.live_line(item)))
        notes = questions.select("query_id", F.explode(live.prompts(F.col("query"), F.col("order_id"), F.col("sku"))).alias("n"))
        return cards.union(notes.select("query_id", F.lit(2), F.concat(F.lit("："), "n"))).withColumn("score", F.lit(None).cast("double"))

    def action_evidence(self, questions: DataFrame) -> DataFrame:
        """query_id, place, item, score (null): the outcome of the action that each question asks
        for, which is run (or waits for its confirmation) and logged."""
        done = self.run_actions(self.requested(questions))
        asked = self.requested(questions).select("action_id", "query_id").distinct()
        line = F.concat_ws(" ", F.concat(F.col("action"), F.lit("：")), "status", F.coalesce("error", F.lit("")))
        return done.join(asked, "action_id").select("query_id", F.lit(0).alias("place"), F.trim(line).alias("item"), F.lit(None).cast("double").alias("score"))

    def _answers(self, questions: DataFrame, evidence: DataFrame, tried: DataFrame) -> DataFrame:
        """Answers from evidence (query_id, channel, place, item, score); ``tried`` has query_id and
        the arrays done and declined of capabilities."""
        none = F.array().cast("array<string>")
        pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("place", "item")))), lambda x: x["item"])
        best = F.max_by("score", F.when(F.col("channel") == "hits", -F.col("place")))
        per = evidence.groupBy("query_id").agg(pick("hits").alias("hits"), pick("facts").alias("paths"), pick("live").alias("live"), pick("actions").alias("actions"), best.alias("score"))
        q = questions.select("query_id", "query", "order_id", "sku").join(per, "query_id", "left").join(tried, "query_id", "left")
        q = q.withColumns({c: F.coalesce(c, none) for c in ("hits", "paths", "live", "actions", "done", "declined")})
        made = answers.synthesise(q).withColumn("n_facts", F.size("paths"))
        made = made.withColumn("score", F.round(ranking.confidence_boost(F.coalesce("score", F.lit(0.0)), F.col("n_facts")), 4))
        made = made.withColumn("confidence", ranking.confidence_label(F.col("score"))).withColumn("guardrail", ranking.guardrail(F.col("score")))
        return live.critic(made.withColumn("n_hits", F.size("hits")).withColumn("n_live", F.size("live")))

    def workers(self, orders: DataFrame, stock: DataFrame, failures: DataFrame | None = None, top_k: int = 5, actions: bool = False) -> list[Worker]:
        """Those who can be asked for evidence. The one who acts joins only where ``actions`` says
        so, and never confirms what it starts."""
        bad = F.contains("item", F.lit("实时数据暂不可用"))
        out = [
            Worker("Retriever", ("retrieval", "semantic"), "hits", lambda q: self.hit_evidence(q, top_k), "search"),
            Worker("GraphReasoner", ("graph", "reasoning"), "facts", self.fact_evidence, "graph walk"),
            Worker("LiveData", ("live", "api"), "live", lambda q: self.live_evidence(q, orders, stock, failures), "lookups", bad),
        ]
        return [*out, Worker("ActionAgent", ("action",), "actions", self.action_evidence, "actions")] if actions else out

    def multi_ask(
        self, questions: DataFrame, orders: DataFrame, stock: DataFrame, failures: DataFrame | None = None, top_k: int = 5, max_rounds: int = 2,
        plans: DataFrame | None = None, actions: bool = False, workers: list[Worker] | None = None, delegate=None,
    ) -> tuple[DataFrame, Outcome]:
        """As :meth:`ask`, in rounds (:mod:`.rounds`): answers with the columns of ``ask`` and how
        they came about (rounds, executed, negotiated, delegated, requests, replies, declined, failed,
        pending_human), and the outcome with the ledger and the stages.

        Questions may say need_graph and need_live; ``plans`` (query_id, answer) are plans that a
        model wrote. Questions whose guardrail fails, or that have an action to confirm, wait for
        a person (pending_human).
        """
        team = workers or self.workers(orders, stock, failures, top_k, actions)
        roster = self.spark.createDataFrame([(w.agent, list(w.capabilities), i) for i, w in enumerate(team)], "agent string, capabilities array<string>, seq int")
        asked = questions.withColumns({c: F.lit(None).cast("boolean") for c in ("need_graph", "need_live") if c not in questions.columns})
        planned = agents.plan(asked, roster) if plans is None else agents.plan_from_answers(plans, asked, roster)
        planned = planned.select("query_id", "agent")
        if actions:  # whoever may act is not for a planner to say
            planned = planned.unionByName(questions.select("query_id", F.lit("ActionAgent").alias("agent")))
        outcome = ask_in_rounds(questions, team, planned, max_rounds, delegate)
        story = stored(outcome.collaboration(questions), "story")
        skills = self.spark.createDataFrame([(w.agent, list(w.capabilities)) for w in team], "agent string, capabilities array<string>")
        # what a worker that failed should have found is still missing
        done = outcome.ran.where("ok").join(F.broadcast(skills), "agent").select("query_id", F.explode("capabilities").alias("c")).groupBy("query_id").agg(F.collect_set("c").alias("done"))
        tried = story.select("query_id", "declined").join(done, "query_id", "left")
        own = questions.withColumn("query_id", F.col("query_id").cast("long"))
        made = self._answers(own, outcome.evidence, tried)
        waits = F.exists("actions", lambda a: F.contains(a, F.lit("needs_confirmation")))
        made = made.select("query_id", "summary", "answer", "score", "confidence", "n_facts", "guardrail", "missing", ((F.col("guardrail") == "escalate") | waits).alias("pending_human"))
        return made.join(story, "query_id"), outcome

    def audit(self, questions: DataFrame, answers: DataFrame, outcome: Outcome) -> None:
        """Append an entry for each question of :meth:`multi_ask` to the audit log."""
        own = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").alias("question"))
        entry = own.join(answers, "query_id").select(
            "query_id", "question", "score", "confidence", "guardrail", "rounds", "declined", "delegated", "pending_human", F.lit(",".join(outcome.failed)).alias("failed"),
        )
        logs.append_audit(entry, f"{self.path}/audit")

    def recent_audit(self, n: int = 50) -> DataFrame:
        return logs.recent_audit(self.spark, f"{self.path}/audit", AUDIT, n)

    # ------------------------------------------------------------ actions

    def requested(self, questions: DataFrame) -> DataFrame:
        """The action that each question asks for, with its parameters."""
        q = F.col("query")
        a = T.intent(q)
        rows = questions.withColumn("action", a).where("action IS NOT NULL")
        only = lambda name, c: F.when(F.col("action") == name, c)
        return rows.select(
            F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), "action", "query"), 256).alias("action_id"), "action",
            T.order_id(q, F.col("order_id")).alias("order_id"), only("update_order", T.order_field(q)).alias("field"), only("update_order", F.substring(q, 1, 200)).alias("value"),
            only("request_refund", T.refund_amount(q)).alias("amount"), only("create_ticket", F.substring(q, 1, 60)).alias("subject"), only("create_ticket", T.ticket_priority(q)).alias("priority"),
            F.lit(False).alias("confirmed"), "query_id", *(c for c in ("customer", "sku") if c in questions.columns),
        )

    def run_actions(self, requests: DataFrame, to_graph: bool = False) -> DataFrame:
        """Validate requests, append their outcomes to the log, and return the rows appended. Their
        seq counts on from the log's last, in the order of query_id and action_id. With ``to_graph``
        the tickets that executed actions open become nodes, with their customer and product (sku)
        where the requests name those; such edges belong to no document."""
        last = self.actions.read().agg(F.max("seq").alias("s")).first().s
        base = 0 if last is None else last + 1
        done = live.action_status(requests).orderBy(*(c for c in ("query_id", "action_id") if c in requests.columns))
        opened = (F.col("action") == "create_ticket") & (F.col("status") == "executed")
        number = F.upper(F.substring(F.sha2("action_id", 256), 1, 16))
        done = done.withColumn("seq", F.monotonically_increasing_id() + base).withColumn("ticket_id", F.when(opened, F.concat(F.lit("TKT-"), number)))
        fields = [c.split() for c in ACTIONS.split(", ")]
        self.actions.append(done.select(*((F.col(c) if c in done.columns else F.lit(None)).cast(t).alias(c) for c, t in fields)))
        rows = self.actions.read().where(F.col("seq") >= base)
        if to_graph:
            self._write_tickets(rows.where(opened))
        return rows

    def _write_tickets(self, opened: DataFrame) -> None:
        last = self.graph.last_seq()
        # one ticket for each action, however often it ran
        first = opened.groupBy("ticket_id").agg(F.min_by(F.struct(*opened.columns), "seq").alias("r")).select("r.*")
        first = first.withColumn("seq", F.col("seq") + (0 if last is None else last + 1)).withColumn("product", F.col("sku"))
        level = F.upper(F.coalesce("priority", F.lit("P2")))
        reply = F.create_map(*(F.lit(x) for pair in V.TICKET_SLA.items() for x in pair))
        props = F.map_filter(F.create_map(F.lit("subject"), "subject", F.lit("priority"), level, F.lit("sla_response"), F.try_element_at(reply, level), F.lit("status"), F.lit("open")), lambda _, v: F.coalesce(v, F.lit("")) != "")
        tickets = first.select(graph.node_key(F.lit("Ticket"), F.col("ticket_id")).alias("key"), F.lit("Ticket").alias("type"), F.col("ticket_id").alias("name"), F.array().cast("array<string>").alias("docs"), "seq", props.alias("props"))
        triples = live.action_effects(first).withColumn("doc_id", F.lit(None).cast("string"))
        triples = graph.valid_triples(triples, graph.relation_schema(self.spark))
        links = triples.select(graph.node_key(F.col("subject_type"), F.col("subject")).alias("src"), "rel", graph.node_key(F.col("object_type"), F.col("object")).alias("dst"), "doc_id", "seq")
        edges = links.groupBy("src", "rel", "dst").agg(F.min("seq").alias("seq"))
        self.graph.upsert(graph.merge_nodes(graph.nodes_of(triples), tickets), edges, links)

    def action_kinds(self) -> DataFrame:
        risks = {"create_ticket": "write", "update_order": "write", "request_refund": "destructive", "list_tickets": "read"}
        return self.spark.createDataFrame(list(risks.items()), "action string, risk string")

    def tickets(self, limit: int = 10) -> DataFrame:
        """The newest executed tickets, 1 to 100 of them."""
        rows = self.actions.read().where("action = 'create_ticket' AND status = 'executed'")
        return rows.orderBy(F.desc("seq")).limit(max(1, min(100, limit)))


def agent_layers(tasks: dict[str, list[str]]) -> list[list[str]]:
    """Tasks in layers: each depends on earlier layers only. Unknown dependencies are ignored; a
    cycle is run as one last layer."""
    left = {t: {d for d in deps if d in tasks} for t, deps in tasks.items()}
    layers = []
    while left:
        ready = sorted(t for t, d in left.items() if not d) or sorted(left)
        layers.append(ready)
        for t in ready:
            del left[t]
        for d in left.values():
            d.difference_update(ready)
    return layers
