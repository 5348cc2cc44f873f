"""Image-region analytics as Spark jobs: pixels, regions, boxes, graphs and labels are tables."""
