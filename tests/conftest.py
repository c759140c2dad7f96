from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from supportgraph.sources.tables import load_graph

# Invented rows. Ticket t1 has two solutions and comments with quotes, line breaks and equal times,
# t2 an unknown category and a solution by an unknown author, t3 is closed without a solution,
# t4 is open with one, t5 has a solution without a time.
TABLES = {
    "user": """userId,username,firstName,lastName,email,role,isActive
u1,ann,Ann,A,ann@example.com,agent,true
u2,bob,Bob,B,bob@example.com,employee,YES
u3,cy,Cy,C,cy@example.com,,0
,ghost,,,,agent,true
""",
    "status": """statusId,name,isClosed
s1,Open,false
s2,Closed,True
s3,Resolved,1
""",
    "priority": """priorityId,name,level
p1,Low,1
p2,High,2.7
p3,Odd,many
p4,None,
""",
    "category": """categoryId,name,description
c1,Printing,Paper and ink
c2,Access,Badges
""",
    "ticket": '''ticketId,title,description,creationDate,resolvedDate,resolutionSummary,createdByUserId,assignedToUserId,statusId,priorityId,categoryId
t1,Printer jams,Paper stuck in tray,2024-01-01 08:00:00,2024-01-03 09:00:00,Cleaned rollers,u2,u1,s2,p1,c1
t2,Badge broken,Door stays shut,2024-01-02 08:00:00,,,u2,,s3,p2,c9
t3,Closed early,Nothing done,2024-01-03 08:00:00,2024-01-03 10:00:00,,u3,u1,s2,p3,c2
t4,Still open,Being worked on,2024-01-04 08:00:00,,,u2,u1,s1,p4,c1
t5,,,,not a date,Replaced,u2,u1,s2,p1,c1
''',
    "comment": '''commentId,content,creationDate,isSolution,ticketId,authorUserId,articleId
m1,"He said ""hello""",2024-01-01 09:00:00,false,t1,u2,
m2,"line one
line two",2024-01-01 10:00:00,False,t1,u1,a1
m3,Same time,2024-01-01 10:00:00,no,t1,u9,
m4,First fix,2024-01-01 11:00:00,true,t1,u1,
m5,Undated,,false,t1,u1,
m6,Second fix,2024-01-02 11:00:00,yes,t1,u3,
m7,Try again,2024-01-02 09:00:00,false,t2,u2,
m8,Ghost fix,2024-01-02 10:00:00,true,t2,u9,
m9,Waiting,2024-01-03 09:00:00,false,t3,u1,
m10,Open fix,2024-01-04 09:00:00,1,t4,u1,a2
m11,Undated fix,,TRUE,t5,u1,
m12,Before,2024-01-05 09:00:00,false,t5,u1,
''',
    "article": """articleId,title,summary,referenceUrl,categoryId
a1,Rollers,How to clean,/a1,c1
a2,Badges,How to print,/a2,c7
""",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def csv_paths(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    paths = {}
    for label, text in TABLES.items():
        path = root / f"{label}.csv"
        path.write_text(text)
        paths[label] = str(path)
    return paths


@pytest.fixture(scope="session")
def graph(spark, csv_paths):
    return load_graph(spark, csv_paths)
