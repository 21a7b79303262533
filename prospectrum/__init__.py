"""Spark-native analytics for lead generation: relational reads, campaign
analytics, scoring, entity resolution, contact cleansing, page cleaning and
delivery-event processing, all as DataFrame programs."""
