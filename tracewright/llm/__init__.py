"""Training-data operators: tokenising, chat, archives, packing, classifiers, shards, media, rules, joins."""
