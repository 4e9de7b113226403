"""Registered domains by a list of public suffixes: the longest rule that matches, with wildcards and exceptions.

A host is cut to its trailing labels, and each cut meets the rules by equality; the list
is broadcast by the planner while it is small, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Common rules, for hosts of ordinary sites; give a whole list where there is one.
COMMON = """com org net edu gov mil int info biz io co ai app dev me tv cc eu de fr nl es it pt pl se no fi dk be ch at cz gr ie ru ua ro hu sk si hr bg lt lv ee lu us ca mx br ar cl pe au nz in cn hk tw sg my th vn id ph kr jp tr il sa ae za ng ke eg ma uk
 co.uk org.uk me.uk ltd.uk plc.uk net.uk sch.uk ac.uk gov.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz co.jp ne.jp or.jp go.jp ac.jp com.br net.br org.br com.cn net.cn org.cn gov.cn com.hk com.tw com.sg com.my com.mx com.ar com.tr co.in net.in org.in co.kr or.kr co.za co.id co.th com.vn com.ph com.pl com.ua co.il com.sa com.eg com.ng co.ke
 *.kawasaki.jp !city.kawasaki.jp *.ck !www.ck *.bd""".split()  # fmt: skip
#: Rules of domains that private owners let to others.
PRIVATE = "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev web.app azurewebsites.net cloudfront.net".split()


def common_rules(spark: SparkSession, private: bool = False) -> DataFrame:
    """The rules above as a table (rule)."""
    return spark.createDataFrame([(r,) for r in dict.fromkeys(COMMON + (PRIVATE if private else []))], "rule string")


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host), rules (rule) -> host, suffix, registered_domain, one row for each different host.

    A rule ``!x`` takes x out of a wildcard, so its suffix is a label shorter; of the others the longest counts, ``*`` standing for
    one label.  The registered domain is the suffix and the label before it; of a host without any rule its last label, of an
    IP address the address, of a host that is a suffix itself an empty text.  Letters are compared in lower case; a last
    dot is dropped.
    """
    plain = F.regexp_replace(F.lower(F.trim("host")), r"\.$", "")
    named = hosts.where("host is not null").select("host").distinct().withColumn("labels", F.split(plain, r"\."))
    named = named.withColumn("address", plain.rlike(r"^[0-9.]+$|:|^\["))
    size = F.size("labels")
    tail = lambda n: F.array_join(F.slice("labels", F.greatest(F.size("labels") - n + 1, F.lit(1)), n), ".")
    each = named.where("not address").select("host", "labels", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("n"))
    each = each.select("host", "size", "n", tail(F.col("n")).alias("tail"))
    kinds = rules.select(F.lower(F.trim("rule")).alias("rule")).distinct()
    kinds = kinds.select(F.when(F.startswith("rule", F.lit("!")), "!").when(F.startswith("rule", F.lit("*.")), "*").otherwise("").alias("kind"), F.regexp_replace("rule", r"^(!|\*\.)", "").alias("tail"))
    labels = F.when(F.col("kind") == "!", F.col("n") - 1).when(F.col("kind") == "*", F.col("n") + 1).otherwise(F.col("n"))
    met = each.join(kinds, "tail").select("host", "kind", labels.alias("n"), "size").where("n <= size")
    best = met.groupBy("host").agg(F.max(F.when(F.col("kind") == "!", F.col("n"))).alias("exception"), F.max(F.when(F.col("kind") != "!", F.col("n"))).alias("rule"))
    out = named.join(best, "host", "left").withColumn("n", F.coalesce("exception", "rule", F.lit(0)))
    domain = F.when(F.col("address"), plain).when(F.col("n") == 0, F.element_at("labels", -1)).when(size > F.col("n"), tail(F.col("n") + 1)).otherwise("")
    return out.select("host", F.when(F.col("n") > 0, tail(F.col("n"))).otherwise("").alias("suffix"), domain.alias("registered_domain"))
