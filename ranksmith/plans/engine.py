"""Requests to one lazy plan: query language and pipelines in, a DataFrame of hits out."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.functions import sparse, vectors
from ranksmith.functions import text as X
from ranksmith.functions.binding import once
from ranksmith.operators import fusion, post, retrieval, shaping, sparse_index, two_phase
from ranksmith.operators.ingest import SEMANTIC_SUFFIX
from ranksmith.operators.models import ModelRegistry
from ranksmith.plans import dsl

NORMALIZATION, RANKER = "normalization-processor", "score-ranker-processor"


@dataclass
class Engine:
    """Plans searches over one corpus (``doc_id`` and fields). ``indices``: sparse indexes by field; ``agent``: text to a query;
    ``alias_filter``: a condition that every request gets, as that of an alias or of document-level security."""

    corpus: DataFrame
    models: ModelRegistry = field(default_factory=ModelRegistry)
    space: str = "l2"
    indices: Mapping[str, sparse_index.SparseIndex] = field(default_factory=dict)
    agent: Callable[[str, Mapping], Mapping] | None = None
    alias_filter: Mapping | None = None

    # Clauses that only say yes or no.
    def condition(self, query: Mapping) -> Column:
        kind, body = dsl.clause(query)
        if kind == "match_all":
            return F.lit(True)
        if kind == "term":
            name, s = dsl.field_body(kind, body)
            return F.col(name) == F.lit(s["value"])
        if kind == "terms":
            name, values = next((k, v) for k, v in body.items() if k != "boost")
            return F.col(name).isin(list(values))
        if kind == "range":
            name, s = dsl.field_body(kind, body)
            ops = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
            if set(s) - set(ops) - {"boost"}:
                raise dsl.QueryError(f"unknown range settings {sorted(set(s) - set(ops))}")
            out = F.col(name).isNotNull()
            for k, v in s.items():
                out = out & ops[k](F.col(name), F.lit(v)) if k in ops else out
            return out
        if kind == "exists":
            return F.col(body["field"]).isNotNull()
        if kind == "match":
            name, s = dsl.field_body(kind, body)
            terms = list(retrieval.analyzed_query(str(s.get("query", s.get("value")))))
            return F.arrays_overlap(X.tokens(F.col(name)), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)
        if kind == "bool":
            out = F.lit(True)
            for key in ("must", "filter"):
                for q in dsl.as_list(body.get(key)):
                    out = out & F.coalesce(self.condition(q), F.lit(False))
            for q in dsl.as_list(body.get("must_not")):
                out = out & ~F.coalesce(self.condition(q), F.lit(False))
            should = dsl.as_list(body.get("should"))
            if should and not body.get("must") and not body.get("filter"):
                some = F.lit(False)
                for q in should:
                    some = some | F.coalesce(self.condition(q), F.lit(False))
                out = out & some
            return out
        if kind == "constant_score":
            return self.condition(body["filter"])
        raise dsl.QueryError(f"[{kind}] cannot be used as a filter")

    # Clauses that score.
    def _rows(self, within: Column | None) -> DataFrame:
        return self.corpus if within is None else self.corpus.filter(within)

    def scored(self, query: Mapping, within: Column | None = None) -> DataFrame:
        """``doc_id, score`` of one clause among the rows that meet ``within``; statistics of words cover the whole corpus."""
        kind, body = dsl.clause(query)
        if kind in ("term", "terms", "range", "exists", "match_all", "constant_score"):
            boost = body.get("boost", 1.0)
            if kind in ("term", "range"):
                boost = dsl.field_body(kind, body)[1].get("boost", 1.0)
            return retrieval.constant(self._rows(within), self.condition(query), boost)
        if kind == "match":
            name, s = dsl.field_body(kind, body)
            return retrieval.match(self.corpus, str(s.get("query", s.get("value"))), name, operator=s.get("operator", "or"), filter=within)
        if kind == "multi_match":
            parts = [retrieval.match(self.corpus, body["query"], name, filter=within) for name in body["fields"]]
            return retrieval.nested_max(_union(parts))
        if kind == "bool":
            return self._boolean(body, within)
        if kind == "nested":
            return self._nested(body, within)
        if kind in ("knn", "neural", "neural_knn"):
            return self._dense(kind, body, within)
        if kind == "neural_sparse":
            return self._sparse(body, within)
        raise dsl.QueryError(f"[{kind}] cannot be scored here")

    def _boolean(self, body: Mapping, within: Column | None) -> DataFrame:
        within = _and(within, self.condition({"bool": {k: body[k] for k in ("filter", "must_not") if k in body}}))
        must, should = dsl.as_list(body.get("must")), dsl.as_list(body.get("should"))
        if not must and not should:
            return retrieval.constant(self._rows(within), F.lit(True), 0.0)
        need = body.get("minimum_should_match", 0 if must or body.get("filter") else 1)
        parts = [[self.scored(q, within) for q in group] for group in (must, should)]
        everything = [retrieval.constant(self._rows(within), F.lit(True), 0.0)] if not must and need == 0 else []
        return retrieval.boolean(parts[0] + everything, parts[1], minimum=need)

    def _children(self, body: Mapping, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The elements of an array column as rows (``doc_id`` is theirs, ``_parent`` and ``_i`` say where they are), and their scores."""
        path = body["path"]
        if body.get("score_mode", "max") != "max":
            raise dsl.QueryError("only score_mode max is supported")
        children = rows.select(F.col("doc_id").alias("_parent"), F.posexplode(path).alias("_i", "_c")).select("_parent", "_i", F.concat_ws("/", "_parent", "_i").alias("doc_id"), "_c.*")
        inner = dsl.rewrite(body["query"], lambda k, b: {n.removeprefix(f"{path}."): v for n, v in b.items()})
        return children, Engine(children, self.models, self.space).scored(inner)

    def _nested(self, body: Mapping, within: Column | None) -> DataFrame:
        """The best child's score of each document."""
        children, found = self._children(body, self._rows(within))
        return retrieval.nested_max(found.join(children.select("doc_id", "_parent"), "doc_id").select(F.col("_parent").alias("doc_id"), "score"))

    def _with_inner_hits(self, out: DataFrame, query: Mapping) -> DataFrame:
        """A column ``inner_hits_<name>`` (the path if no name is given) for each nested clause that asks for it: the best children
        of each hit, with their score and place in the array. Only children of the page's hits are scored."""
        for kind, body in dsl.walk(query):
            if kind != "nested" or body.get("inner_hits") is None:
                continue
            s, path = body["inner_hits"], body["path"]
            children, found = self._children(body, out.select("doc_id", path))
            fields = [c for c in children.columns if c not in ("_parent", "_i", "doc_id")]
            rows = found.join(children, "doc_id").select(F.col("_parent").alias("doc_id"), F.col("_i").alias("child"), "score", *fields)
            rows = retrieval.inner_hits(rows, s.get("size", 3), s.get("from", 0))
            texts = self._highlighter(s.get("highlight"), query)
            rows = texts(rows, path) if texts else rows
            marked = [c for c in rows.columns if c not in ("doc_id", "place")]
            lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", *marked))).alias(f"inner_hits_{s.get('name', path)}"))
            out = out.join(lists, "doc_id", "left")
        return out

    def _target(self, name: str, rows: DataFrame) -> tuple[str, bool, bool]:
        """The embedding column of a field, whether it lies in chunks, and whether it is sparse."""
        at = rows.schema
        info = name + SEMANTIC_SUFFIX
        if info in at.names:
            body = at[info].dataType
            chunked = "chunks" in body.names
            inner = body["chunks"].dataType.elementType["embedding"] if chunked else body["embedding"]
            return f"{info}.chunks" if chunked else f"{info}.embedding", chunked, isinstance(inner.dataType, T.MapType)
        return name, False, name in at.names and isinstance(at[name].dataType, T.MapType)

    def _dense(self, kind: str, body: Mapping, within: Column | None) -> DataFrame:
        name, s = dsl.field_body(kind, body)
        rows = self._rows(within)
        target, chunked, is_sparse = self._target(name, rows)
        if is_sparse:
            return self._sparse({name: {k: v for k, v in s.items() if k in ("query_text", "query_tokens", "model_id", "boost")}}, within)
        vector = s.get("vector")
        if vector is None:
            texts = [s.get("query_text")] + ([s["query_image"]] if s.get("query_image") else [])
            vector = self.models.encode_query(s["model_id"], *texts)
        rows = rows.filter(self.condition(s["filter"])) if s.get("filter") else rows
        limits = {k: s[k] for k in ("k", "max_distance", "min_score") if s.get(k) is not None}
        if not chunked:
            out = retrieval.knn(rows, vector, space=self.space, vector=target, **limits)
        else:
            children = rows.select("doc_id", F.explode(target).alias("_c")).select("doc_id", F.col("_c.embedding").alias("embedding"))
            score = F.round(vectors.score(F.col("embedding"), vectors.literal(vector), self.space), retrieval.DIGITS)
            scored = retrieval.nested_max(children.select("doc_id", score.alias("score")))
            out = scored.filter(F.col("score") >= s["min_score"]) if "min_score" in limits else retrieval.top(scored, s.get("k") or 10)
        return out.withColumn("score", F.col("score") * s["boost"]) if s.get("boost", 1.0) != 1.0 else out

    def _sparse(self, body: Mapping, within: Column | None) -> DataFrame:
        name, s = dsl.field_body("neural_sparse", body)
        rows = self._rows(within)
        tokens = self._query_tokens(s)
        boost, ann = s.get("boost", 1.0), s.get("method_parameters")
        if ann is not None and name in self.indices:
            index = self.indices[name]
            rows = rows.filter(self.condition(ann["filter"])) if ann.get("filter") else rows
            allowed = rows.select("doc_id") if ann.get("filter") or within is not None else None
            # Below the index's threshold the search is exact.
            found = sparse_index.search(index, {int(k): v for k, v in tokens.items()}, ann.get("k", 10), ann.get("top_n", 10), ann.get("heap_factor", 1.0), allowed, boost, index.documents)
            return found.select("doc_id", "score")
        target, chunked, _ = self._target(name, rows)
        if chunked:
            rows = rows.select("doc_id", F.explode(target).alias("_c")).select("doc_id", F.col("_c.embedding").alias("_v"))
            return retrieval.nested_max(retrieval.sparse_match(rows, tokens, "_v", boost=boost))
        return retrieval.sparse_match(rows.withColumn("_v", F.col(target)), tokens, "_v", boost=boost)

    def _query_tokens(self, s: Mapping) -> Mapping[str, float]:
        """Given tokens, those of a model, or those of the analyzer."""
        if s.get("query_tokens") is not None:
            return s["query_tokens"]
        return self.models.encode_query(s["model_id"], s["query_text"]) if s.get("model_id") else retrieval.analyzed_query(s["query_text"])

    # Request processors.
    def prepared(self, request: Mapping, pipeline: Mapping | None = None) -> dict:
        """The request after its request processors."""
        request = dict(request)
        query = request.get("query", {"match_all": {}})
        for processor in (pipeline or {}).get("request_processors", []):
            (name, settings), *_ = processor.items()
            if name == "agentic_query_translator" and dsl.clause(query)[0] == "agentic":
                query, request = self._translated(request)
            elif name == "neural_query_enricher":
                query = dsl.rewrite(query, _Enricher(settings))
            elif name == "neural_sparse_two_phase_processor":
                query, request["_second_phase"] = self._two_phased(query, request, settings)
            elif name not in ("agentic_query_translator",):
                raise dsl.QueryError(f"unknown request processor {name!r}")
        if dsl.clause(query)[0] == "agentic":
            raise dsl.QueryError("an agentic query needs the agentic_query_translator processor")
        query = dsl.add_filter(query, self.alias_filter) if self.alias_filter else query
        return {**request, "query": query}

    def _translated(self, request: Mapping) -> tuple[dict, dict]:
        dsl.validate(request["query"])
        if self.agent is None:
            raise dsl.QueryError("no agent is set")
        barred = [k for k in ("aggs", "sort", "highlight", "post_filter", "suggest", "rescore", "collapse") if request.get(k)]
        if barred:
            raise dsl.QueryError(f"agentic queries do not go with {barred}")
        body = dsl.clause(request["query"])[1]
        answer = self.agent(dsl.cleaned_agentic_text(body["query_text"]), body)
        if len(str(answer)) > dsl.MAX_TRANSLATED_CHARS:
            raise dsl.QueryError("the agent's query is too long")
        kept = {k: request[k] for k in ("_source", "ext") if k in request}
        said = {"agent_steps": answer.get("agent_steps"), "memory_id": answer.get("memory_id", body.get("memory_id")), "dsl_query": json.dumps(answer["query"])}
        return dict(answer["query"]), {**{k: v for k, v in answer.items() if k not in ("agent_steps", "memory_id")}, **kept, "_agent": said}

    def _two_phased(self, query: Mapping, request: Mapping, settings: Mapping) -> tuple[dict, dict | None]:
        """The query with heavy tokens only, and what the window of its best hits is rescored by: the light ones of each clause."""
        s = {**two_phase.DEFAULTS, **settings.get("two_phase_parameter", {}), "enabled": settings.get("enabled", True)}
        if not s["enabled"] or s["prune_ratio"] == 0 or not two_phase.applies(dsl.as_list(request.get("sort"))):
            return dict(query), None
        window = two_phase.check_parameters(request.get("size", 10), s["expansion_rate"], s["max_window_size"])
        light: list[dict] = []

        def change(kind: str, body: dict) -> dict:
            if kind != "neural_sparse":
                return body
            name, own = dsl.field_body(kind, body)
            if own.get("method_parameters") is not None:
                two_phase.applies(None, targets_ann=True)
            high, low = two_phase.split_query(self._query_tokens(own), s["prune_type"], s["prune_ratio"])
            if low:
                light.append({"neural_sparse": {name: {"query_tokens": low, "boost": own.get("boost", 1.0)}}})
            return {name: {"query_tokens": high, "boost": own.get("boost", 1.0)}}

        kind, body = dsl.clause(query)
        if kind == "neural_sparse":
            query = {kind: change(kind, body)}
        elif kind == "bool" and body.get("should"):
            query = {kind: {**body, "should": [dsl.rewrite(q, change) for q in dsl.as_list(body["should"])]}}
        return dict(query), {"queries": light, "window": window, "weight": body.get("boost", 1.0) if kind == "bool" else 1.0} if light else None

    def _second_phase(self, found: DataFrame, spec: Mapping) -> DataFrame:
        """The window's hits with the scores of the light tokens added; only the window's rows are read again."""
        head = retrieval.top(found, spec["window"]).select("doc_id")
        inside = Engine(self.corpus.join(F.broadcast(head), "doc_id", "left_semi"), self.models, self.space)  # at most max_window_size rows
        more = _union([inside.scored(q) for q in spec["queries"]]).groupBy("doc_id").agg(F.sum("score").alias("score"))
        if spec.get("closed"):
            first = retrieval.top(found, spec["window"]).join(F.broadcast(more.withColumnRenamed("score", "_second")), "doc_id", "left")
            return F.broadcast(first.select("doc_id", F.round(F.col("score") + F.coalesce("_second", F.lit(0.0)) * spec["weight"], retrieval.DIGITS).alias("score")))
        return shaping.rescore(found, more, spec["window"], 1.0, spec["weight"])

    @staticmethod
    def _closed(request: Mapping, spec: Mapping) -> bool:
        """Whether the page comes from the window alone: it ends within it, and no light token takes anything from a score."""
        plain = not any(request.get(k) for k in ("search_after", "collapse", "rescore"))
        bodies = [dsl.field_body("neural_sparse", q["neural_sparse"])[1] for q in spec["queries"]]
        rising = spec["weight"] >= 0 and all(b["boost"] >= 0 and min(b["query_tokens"].values()) >= 0 for b in bodies)
        return plain and rising and request.get("from", 0) + request.get("size", 10) <= spec["window"]

    def _both_phases(self, request: Mapping, spec: Mapping) -> DataFrame | None:
        """The window of one sparse query with heavy and light tokens scored in one pass over the corpus; None for other queries."""
        kind, body = dsl.clause(request["query"])
        if kind != "neural_sparse" or request.get("post_filter"):
            return None
        name, s = dsl.field_body(kind, body)
        target, chunked, _ = self._target(name, self.corpus)
        if chunked:
            return None
        light = dsl.field_body(kind, spec["queries"][0][kind])[1]
        score = lambda q: F.round(sparse.dot(sparse.literal(q["query_tokens"]), F.col(target)) * q["boost"], retrieval.DIGITS)
        rows = self.corpus.select("doc_id", once(F.struct(score(s).alias("score"), score(light).alias("_second"))).alias("_s")).select("doc_id", "_s.*")
        first = retrieval.top(rows.filter("score > 0"), spec["window"])
        return F.broadcast(first.select("doc_id", F.round(F.col("score") + F.col("_second") * spec["weight"], retrieval.DIGITS).alias("score")))

    # The whole request.
    def _lists(self, query: Mapping, after: Mapping | None = None) -> list[DataFrame]:
        """The scored lists of a hybrid query's sub-queries, or the only one of another query. The post filter ``after`` narrows them
        once nearest neighbours are found."""
        within, kept = None, None
        if after:
            within = kept = self.condition(after)
            if any(kind in ("knn", "neural", "neural_knn") or "method_parameters" in str(body) for kind, body in dsl.walk(query)):
                within = None
        lists = self._scored_lists(query, within)
        return lists if kept is None or within is not None else [x.join(self.corpus.filter(kept).select("doc_id"), "doc_id", "left_semi") for x in lists]

    def _scored_lists(self, query: Mapping, within: Column | None) -> list[DataFrame]:
        kind, body = dsl.clause(query)
        if kind == "bool" and any(dsl.clause(q)[0] == "hybrid" for q in dsl.as_list(body.get("must"))):
            # A wrapped hybrid is a plain sum of its sub-queries' scores.
            inner = dsl.clause(dsl.as_list(body["must"])[0])[1]
            first = {k: dsl.as_list(body[k])[:1] for k in ("filter", "must_not") if body.get(k)}
            return [self.scored({"bool": {"must": [{"bool": {"should": inner["queries"]}}], **first}}, within)]
        if kind != "hybrid":
            return [self.scored(query, within)]
        within = _and(within, self.condition(body["filter"])) if body.get("filter") else within
        return [self.scored(q, within) for q in body["queries"]]

    def hits(self, request: Mapping, pipeline: Mapping | None = None) -> DataFrame:
        """All matching ``doc_id, score`` (and ``explanation`` if asked for), before paging. A post filter holds before candidates
        are cut, and does not touch aggregations."""
        query = request.get("query", {"match_all": {}})
        kind, body = dsl.clause(query)
        lists = self._lists(query, request.get("post_filter"))
        if kind != "hybrid":
            return self._second_phase(lists[0], request["_second_phase"]) if request.get("_second_phase") else lists[0]
        depth, how = body.get("pagination_depth") or request.get("size", 10), fusion_settings(pipeline)
        fuse = fusion.explain if request.get("explain") else fusion.fuse
        return fuse(lists, depth, how["normalization"], how["combination"], how["weights"], **how["parameters"])

    def _sorted_hits(self, request: Mapping, sort: shaping.Sort) -> DataFrame:
        """Source rows in the order of a sort by fields, whose score is null: each sub-query's candidates are those that come first
        in that order (after ``search_after``), whatever they score."""
        query = request["query"]
        kind, body = dsl.clause(query)
        fields = [c for c, _ in sort] + ([request["collapse"]["field"]] if request.get("collapse") else [])
        rows = self.corpus.select("doc_id", *dict.fromkeys(c for c in fields if c not in ("doc_id", "score")))
        each = []
        for i, found in enumerate(self._lists(query, request.get("post_filter"))):
            found = found.filter("score > 0") if kind == "hybrid" else found
            each.append(found.select("doc_id", F.lit(i).alias("sub_query")).join(rows, "doc_id"))
        found = _union(each)
        if request.get("search_after") is not None:
            found = shaping.search_after(found, sort, request["search_after"])
        if kind == "hybrid":
            found = shaping.sort_lists(found, sort, body.get("pagination_depth") or request.get("size", 10))
        return found.select("doc_id", F.lit(None).cast("double").alias("score")).join(self.corpus, "doc_id")

    def search(self, request: Mapping, pipeline: Mapping | None = None) -> DataFrame:
        """Hits with their source fields, in order. Aggregations are planned apart, over ``hits`` joined to the corpus."""
        request = self.prepared(request, pipeline)
        dsl.check_request(request)
        sort = [_sort_of(s) for s in dsl.as_list(request.get("sort"))] or list(shaping.BY_SCORE)
        if "score" in [c for c, _ in sort]:
            spec = request.get("_second_phase")
            if spec and sort == list(shaping.BY_SCORE):
                request["_second_phase"] = spec = {**spec, "closed": self._closed(request, spec)}
            found = self._both_phases(request, spec) if spec and spec.get("closed") else None
            found = self.hits(request, pipeline) if found is None else found
            if request.get("min_score") is not None:
                found = shaping.at_least(found, request["min_score"])
            out = found.join(self.corpus, "doc_id")
            for r in dsl.as_list(request.get("rescore")):
                q = r["query"]
                out = shaping.rescore(out, self.scored(q["rescore_query"]), r.get("window_size", 10), q.get("query_weight", 1.0), q.get("rescore_query_weight", 1.0))
            if request.get("search_after") is not None:
                out = shaping.search_after(out, sort, request["search_after"])
        else:
            out = self._sorted_hits(request, sort)
        if request.get("collapse"):
            out = shaping.collapse(out, request["collapse"]["field"], sort)
        out = shaping.page(out, request.get("size", 10), request.get("from", 0), sort)
        wanted = self._highlighter(request.get("highlight"), request["query"])
        out = wanted(out) if wanted else out
        nested = any(k == "nested" and b.get("inner_hits") is not None for k, b in dsl.walk(request["query"]))
        out = self._with_inner_hits(out, request["query"]).orderBy(*shaping.order(sort)) if nested else out
        names = [next(iter(p)) for p in (pipeline or {}).get("response_processors", [])]
        if "explanation" in out.columns and "explanation" not in self.corpus.columns and "hybrid_score_explanation" not in names:
            out = out.drop("explanation")
        for processor in (pipeline or {}).get("response_processors", []):
            out = self._responded(out, processor, request)
        if "_source" in request:
            added = [c for c in out.columns if c.startswith(("inner_hits_", "ext_")) or c.endswith("_highlight") or c == "explanation"]
            out = out.select("doc_id", "score", *[c for c in request["_source"] if c in out.columns], *[c for c in added if c not in request["_source"]])
        return out

    def _highlighter(self, highlight: Mapping | None, query: Mapping) -> Callable | None:
        """A function that adds ``<field>_highlight`` for each field whose highlighter is ``semantic``; a field's options and tags go before
        the common ones, and the text is that of ``highlight_query``, else of the main query."""
        targets = {n: s for n, s in (highlight or {}).get("fields", {}).items() if s.get("type", highlight.get("type")) == "semantic"}
        if not targets:
            return None
        texts = post.query_texts(highlight.get("highlight_query") or query)

        def add(rows: DataFrame, path: str = "") -> DataFrame:
            for name, own in targets.items():
                options = {**highlight.get("options", {}), **own.get("options", {})}
                tags = {k: next(iter(dsl.as_list(own.get(f"{k}_tags")) or dsl.as_list(highlight.get(f"{k}_tags"))), options.get(f"{k}_tag")) for k in ("pre", "post")}
                name = name.removeprefix(f"{path}.") if path else name
                rows = rows.withColumn(f"{name}_highlight", self._marked(F.col(name), texts, options, tags["pre"] or "<em>", tags["post"] or "</em>"))
            return rows

        return add

    def _marked(self, column: Column, texts: list[str], options: Mapping, pre: str, behind: str) -> Column:
        """Tagged text, by a model's spans or by the words of the query."""
        encoder, head = options.get("encoder", "default"), options.get("no_match_size", 0)
        if options.get("model_id"):
            size = options.get("max_inference_batch_size", post.MAX_BATCH_SIZE) if options.get("batch_inference") else 1
            spans = self.models.column(options["model_id"], F.lit(" ".join(texts)), column, batch_size=size)
            return post.highlight(column, spans, pre, behind, encoder, head)
        words = tuple(dict.fromkeys(w for t in texts for w in retrieval.analyzed_query(t)))
        return post.highlight_terms(column, words, pre, behind, encoder, head)

    def _responded(self, out: DataFrame, processor: Mapping, request: Mapping) -> DataFrame:
        (name, settings), *_ = processor.items()
        if name == "rerank":
            kind, own = post.rerank_config(settings)
            if kind == "by_field":
                return post.rerank_by_field(out, own["target_field"], own.get("keep_previous_score", False), own.get("remove_target_field", False))
            context = request.get("ext", {}).get("rerank", {}).get("query_context", {})
            fields = settings["context"]["document_fields"]
            model = own.get("model_id")
            scorer = post.overlap_score if model is None else (lambda q, d: self.models.column(model, F.lit(q), d))
            return post.rerank(out, post.rerank_query(context, request), fields, scorer)
        if name == "semantic_highlighter":
            texts = post.query_texts(request["query"])
            for f in settings["fields"]:
                out = out.withColumn(f"{f}_highlight", self._marked(F.col(f), texts, settings, settings.get("pre_tag", "<em>"), settings.get("post_tag", "</em>")))
            return out
        if name == "hybrid_score_explanation":
            return out  # the column comes with the fused result of a request that asks to explain
        if name == "agentic_context":
            said = request.get("_agent", {})
            shown = {"agent_steps": settings.get("agent_steps_summary", False), "memory_id": True, "dsl_query": settings.get("dsl_query", False)}
            return out.withColumns({f"ext_{k}": F.lit(said[k]) for k, show in shown.items() if show and said.get(k) is not None})
        raise dsl.QueryError(f"unknown response processor {name!r}")

    def matched(self, request: Mapping, pipeline: Mapping | None = None) -> DataFrame:
        """Source rows that any sub-query matches, for aggregations."""
        from ranksmith.operators.aggregations import matched

        request = self.prepared(request, pipeline)
        return matched(self.corpus, self._lists(request["query"]))


class _Enricher:
    """Fills in missing model ids from the field's default, then the global one."""

    def __init__(self, settings: Mapping):
        self.default, self.by_field = settings.get("default_model_id"), settings.get("neural_field_default_id", {})

    def __call__(self, kind: str, body: dict) -> dict:
        if kind not in ("neural", "neural_sparse"):
            return body
        name, own = dsl.field_body(kind, body)
        if own.get("model_id") or own.get("query_tokens") or own.get("analyzer"):
            return body
        model = self.by_field.get(name, self.default)
        if model is None:
            raise dsl.QueryError(f"no model id for field {name}")
        return {name: {**own, "model_id": model}}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _and(a: Column | None, b: Column) -> Column:
    return b if a is None else F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def _sort_of(sort) -> tuple[str, bool]:
    name, order = (next(iter(sort.items())) if isinstance(sort, Mapping) else (sort, None))
    order = order.get("order") if isinstance(order, Mapping) else order
    name = "score" if name == "_score" else name
    return name, (order or ("desc" if name == "score" else "asc")) == "desc"


def fusion_settings(pipeline: Mapping | None) -> dict:
    """Normalization, combination, weights and parameters of a pipeline's phase processor."""
    out = {"normalization": "min_max", "combination": "arithmetic_mean", "weights": None, "parameters": {}}
    processors = (pipeline or {}).get("phase_results_processors", [])
    if len(processors) > 1:
        raise dsl.QueryError("one phase results processor at most")
    for processor in processors:
        (name, s), *_ = processor.items()
        combination = s.get("combination", {})
        out["weights"] = combination.get("parameters", {}).get("weights")
        if name == NORMALIZATION:
            normalization = s.get("normalization", {})
            out["normalization"] = normalization.get("technique", "min_max")
            out["parameters"] = dict(normalization.get("parameters", {}))
            out["combination"] = combination.get("technique", "arithmetic_mean")
        elif name == RANKER:
            if combination.get("technique", "rrf") != "rrf":
                raise dsl.QueryError(f"{RANKER} combines by rrf only")
            out["normalization"] = out["combination"] = "rrf"
            out["parameters"] = {"rank_constant": combination["rank_constant"]} if "rank_constant" in combination else {}
        else:
            raise dsl.QueryError(f"unknown phase results processor {name!r}")
    fusion.check_techniques(out["normalization"], out["combination"])
    return out
