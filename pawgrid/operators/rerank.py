"""Re-rank data flow around an external chat model (RR1–RR5, PRJ11, SRT4, SNK5, WIN2, WIN4).

The model call itself is not part of the library; these operators prepare the prompt rows
for every query at once and parse the reply rows back into ranked picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.describe import candidate_text
from pawgrid.functions.text import format_fixed, pystrip


def candidate_rows(top: DataFrame, listings: DataFrame, link_prefix: str, uid: str = "uid") -> DataFrame:
    """PRJ11: ``(qid, rank, uid, similarity)`` + the listing fields of each candidate.

    Every row of ``top`` stays, whatever the sizes; a uid that is no listing has null fields."""
    d = K.CANDIDATE_DEFAULTS

    def get(c: str, default=None) -> Column:
        return F.col(c) if c in listings.columns else F.lit(default).cast("string")

    lst = listings.select(
        F.col(uid).cast("long").alias("uid"),
        get("addinfo01").alias("name"), get("addinfo03").alias("gender"),
        get("addinfo07").cast("string").alias("weight"),
        F.coalesce(get("addinfo05"), F.lit(d["age"])).alias("age"),
        F.coalesce(get("addinfo04"), F.lit(d["neuter"])).cast("string").alias("neuter"),
        get("addinfo08").alias("personality_tags"), get("addinfo10", "").alias("personality_desc"),
        get("addinfo09", "").alias("rescue_story"), get("addinfo16", "").alias("special_needs"),
        get("state").alias("state"), F.coalesce(get("kind"), F.lit(d["kind"])).alias("kind"),
    )
    link = F.when(F.col("uid").isNull() | (F.col("uid").cast("string") == ""), F.lit(K.NO_LINK)) \
        .otherwise(F.concat(F.lit(link_prefix), F.col("uid").cast("string")))
    return top.join(lst, "uid", "left").withColumn("link", link)


def with_candidate_text(cands: DataFrame, out: str = "description", personality_length: int | None = None,
                        story_length: int | None = None) -> DataFrame:
    """RR2: the per-candidate description used in the prompt; whole texts unless lengths are given."""
    return cands.withColumn(out, candidate_text(F.col("gender"), F.col("weight"), F.col("personality_tags"),
                                                F.col("personality_desc"), F.col("special_needs"),
                                                F.col("rescue_story"), personality_length, story_length))


def prompts(cands: DataFrame, queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """RR1: one prompt per query: header, numbered candidates (rank order), instructions.

    Per query the candidate list is bounded by k, so the per-group collect is bounded."""
    item = F.format_string(K.PROMPT_ITEM.replace("{i}", "%d").replace("{name}", "%s")
                           .replace("{description}", "%s").replace("{similarity}", "%s"),
                           F.col("rank").cast("int"), F.col("name"), F.col("description"),
                           format_fixed("similarity", 3))
    body = (cands.groupBy(qid)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), item.alias("t")))).alias("items"))
            .select(qid, F.array_join(F.transform("items", lambda x: x["t"]), "").alias("body")))
    head = F.format_string(K.PROMPT_HEAD.replace("{query}", "%s"), F.col(text))
    return (queries.select(qid, text).join(body, qid, "inner")
            .select(qid, F.concat(head, F.col("body"), F.lit(K.PROMPT_TAIL)).alias("prompt")))


def parse_replies(replies: DataFrame, qid: str = "qid", reply: str = "reply",
                  picks: int = K.FALLBACK_PICKS) -> DataFrame:
    """RR3: reply text -> ``(qid, item, name, reason)``.

    Lines are stripped.  A line starting ``1.``..``<picks>.`` (the number of picks that the prompt
    asked for) opens an item (name = text after the
    last ``이름:``, when present); a line starting ``이유:`` sets the reason of the open item,
    later ones overwrite.  An item opened without a name is dropped with its reason; other
    numbers open nothing.  ``item`` numbers the kept items 1.. in reply order (WIN2).

    Replies are independent, so each is parsed inside its own row with array functions: the
    positions of the opening lines are found, each item's reason is the last reason line
    before the next opening line (the carry-forward of WIN4), and only the kept items are
    exploded.  No shuffle, and no key — however many replies share a ``qid`` — is grouped."""
    # staged projections: the stripped lines and the opening positions are columns, so the
    # lambdas below index them instead of re-splitting the reply for every element
    staged = replies.select(qid, F.transform(F.split(F.coalesce(F.col(reply), F.lit("")), "\n"),
                                             lambda s: pystrip(s)).alias("__lines"))
    lines = F.col("__lines")
    n = F.size(lines)

    def opens(line: Column) -> Column:
        out = F.lit(False)
        for i in range(1, picks + 1):
            out = out | line.startswith(f"{i}.")
        return out

    staged = staged.select(qid, "__lines", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                    lambda i: opens(F.element_at(lines, i))).alias("__starts"))
    starts = F.col("__starts")

    def item(s: Column, k: Column) -> Column:
        head = F.element_at(lines, s)
        nxt = F.coalesce(F.try_element_at(starts, k + 2), n + 1)
        body = F.slice(lines, s + 1, nxt - s - 1)
        last_reason = F.try_element_at(F.filter(body, lambda x: x.startswith(K.REPLY_REASON_MARK)), F.lit(-1))
        return F.struct(
            head.contains(K.REPLY_NAME_MARK).alias("named"),
            pystrip(F.element_at(F.split(head, K.REPLY_NAME_MARK), -1)).alias("name"),
            pystrip(F.replace(last_reason, F.lit(K.REPLY_REASON_MARK), F.lit(""))).alias("reason"),
        )

    kept = F.filter(F.transform(starts, item), lambda it: it["named"])
    return (staged.select(qid, F.posexplode(kept).alias("pos", "it"))
            .select(qid, (F.col("pos") + 1).cast("long").alias("item"),
                    F.col("it.name").alias("name"), F.col("it.reason").alias("reason")))


def shown_picks(picks: DataFrame) -> DataFrame:
    """RR4: only picks with both a name and a reason are shown."""
    return picks.where(F.col("name").isNotNull() & F.col("reason").isNotNull())


def final_picks(picks: DataFrame, cands: DataFrame, qid: str = "qid",
                fallback: int = K.FALLBACK_PICKS) -> DataFrame:
    """SRT4: the parsed picks joined back to the candidates on (qid, name) to recover uid and
    similarity rank; a query with no pick falls back to its top ``fallback`` candidates.

    Output ``(qid, pick_rank, name, uid, sim_rank, source)``; ``source`` is ``rerank`` or
    ``similarity``.  A pick name matching no candidate keeps null uid / sim_rank."""
    c = cands.select(qid, F.col("name"), F.col("uid"), F.col("rank").alias("sim_rank"))
    # one candidate per (qid, name): the best-ranked, so a duplicate name cannot fan out
    c1 = c.groupBy(qid, "name").agg(F.min_by("uid", "sim_rank").alias("uid"), F.min("sim_rank").alias("sim_rank"))
    chosen = (picks.select(qid, F.col("item").alias("pick_rank"), "name")
              .join(c1, [qid, "name"], "left")
              .select(qid, "pick_rank", "name", "uid", "sim_rank", F.lit("rerank").alias("source")))
    has = picks.select(qid).distinct()
    fb = (cands.join(has, qid, "left_anti").where(F.col("rank") <= fallback)
          .select(qid, F.col("rank").alias("pick_rank"), "name", "uid", F.col("rank").alias("sim_rank"),
                  F.lit("similarity").alias("source")))
    return chosen.unionByName(fb)


def pick_log(picks: DataFrame, queries: DataFrame, satisfaction: Column | None = None,
                       ts: Column | None = None, qid: str = "qid", text: str = "text") -> DataFrame:
    """SNK5 rows: ``(timestamp, user_query, rank, animal_name, reason, satisfaction)`` with the
    defaults for a missing name / reason; rank is the pick's position 1.. (WIN2)."""
    stamp = ts if ts is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    sat = satisfaction if satisfaction is not None else F.lit(None).cast("int")
    return (picks.join(queries.select(qid, F.col(text).alias("user_query"), sat.alias("satisfaction")), qid, "inner")
            .select(stamp.alias("timestamp"), "user_query", F.col("item").cast("long").alias("rank"),
                    F.coalesce(F.col("name"), F.lit(K.LOG_NO_NAME)).alias("animal_name"),
                    F.coalesce(F.col("reason"), F.lit(K.LOG_NO_REASON)).alias("reason"),
                    "satisfaction"))
