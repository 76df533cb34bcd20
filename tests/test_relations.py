from shardframe.operators.relations import BelongsTo, BelongsToMany, HasMany, HasManyThrough, HasOne, HasOneThrough, MorphMany, MorphOne, MorphTo, MorphToMany


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_belongs_to_with_null_keys(spark):
    users = frame(spark, [(1, 10), (2, None), (3, 99)], "id long, organization_id long")
    orgs = frame(spark, [(10,), (11,)], "id long")
    rows = BelongsTo("organization_id", "id").load(users, orgs).orderBy("id").collect()
    assert [r["parent_id"] for r in rows] == [10, None, None]


def test_has_many_and_one(spark):
    parents = frame(spark, [(1,), (2,), (3,)], "id long")
    children = frame(spark, [(4, 2), (1, 1), (2, 1), (3, 2)], "id long, parent_id long")
    rel = HasMany("parent_id", "id", "id")
    assert sorted((r["id"], r["child_id"]) for r in rel.load(parents, children, "inner").collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    nested = {r["id"]: [c["id"] for c in r["children"]] for r in rel.nested(parents, children).collect()}
    assert nested == {1: [1, 2], 2: [3, 4], 3: []}
    one = {r["id"]: r["child_id"] for r in HasOne("parent_id", "id", "id").load(parents, children).collect()}
    assert one == {1: 1, 2: 3, 3: None}


def test_through(spark):
    parents = frame(spark, [(1,), (2,)], "id long")
    middles = frame(spark, [(10, 1), (11, 1)], "id long, parent_id long")
    children = frame(spark, [(5, 11), (6, 10), (7, 12)], "id long, middle_id long")
    args = ("parent_id", "middle_id", "id", "id", "id")
    assert sorted((r["id"], r["child_id"]) for r in HasManyThrough(*args).load(parents, middles, children).collect()) == [(1, 5), (1, 6)]
    assert {r["id"]: r["child_id"] for r in HasOneThrough(*args).load(parents, middles, children).collect()} == {1: 5, 2: None}


def test_many_to_many(spark):
    posts = frame(spark, [(1, "a"), (2, "b")], "id long, _shard string")
    pivot = frame(spark, [(1, 7, "post", "a"), (1, 8, "post", "b"), (2, 7, "video", "b")], "post long, tag long, kind string, _shard string")
    tags = frame(spark, [(7, "a"), (8, "a")], "id long, _shard string")
    rel = BelongsToMany("post", "tag", "id", "id")
    assert sorted((r["id"], r["related_id"]) for r in rel.load(posts, pivot, tags).collect()) == [(1, 7), (1, 8), (2, 7)]
    local = BelongsToMany("post", "tag", "id", "id", same_shard=True)
    assert [(r["id"], r["related_id"]) for r in local.load(posts, pivot, tags).collect()] == [(1, 7)]
    typed = MorphToMany("post", "tag", "id", "id", type_column="kind", type_name="post")
    assert sorted((r["id"], r["related_id"]) for r in typed.load(posts, pivot, tags).collect()) == [(1, 7), (1, 8)]
    assert sorted((r["id"], r["related_id"]) for r in typed.inverse().load(tags, pivot, posts).collect()) == [(7, 1), (8, 1)]


def test_morphs(spark):
    posts, videos = frame(spark, [(1, "p")], "id long, title string"), frame(spark, [(1, "v")], "id long, name string")
    notes = frame(spark, [(3, "post", 1), (2, "post", 1), (4, "video", 1), (5, "other", 1), (6, None, 1)], "id long, kind string, owner long")
    assert sorted(r["child_id"] for r in MorphMany("kind", "owner", "post", "id", "id").load(posts, notes).collect()) == [2, 3]
    assert [r["child_id"] for r in MorphOne("kind", "owner", "post", "id", "id").load(posts, notes).collect()] == [2]
    found = {r["id"]: (r["owner_title"], r["owner_name"]) for r in MorphTo("kind", "owner").load(notes, {"post": (posts, "id"), "video": (videos, "id")}).collect()}
    assert found == {2: ("p", None), 3: ("p", None), 4: (None, "v"), 5: (None, None), 6: (None, None)}
